"""Pages from the web, with the URL guard before the first request and before every redirect."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Sequence

from passagemill.sources.guard import BlockedFetchError, SecurityError, check_url, resolve_host

MAX_REDIRECTS = 10
MAX_BYTES = 104_857_600
TIMEOUT_SECONDS = 30


class _CheckedRedirects(urllib.request.HTTPRedirectHandler):
    max_redirections = MAX_REDIRECTS

    def __init__(self, check: Callable[[str], None]):
        self.check = check

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.check(newurl)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch(url: str, allow_private: bool = False, resolve: Callable[[str], Sequence[str]] | None = resolve_host) -> str:
    """The HTML of a page.  A refused URL or redirect target is a :class:`BlockedFetchError` that names it."""

    def check(target: str) -> None:
        try:
            check_url(target, allow_private, resolve)
        except SecurityError as e:
            raise BlockedFetchError(target, str(e)) from e

    check(url)
    opener = urllib.request.build_opener(_CheckedRedirects(check), urllib.request.ProxyHandler({}))
    request = urllib.request.Request(url, headers={"Accept": "text/markdown, text/html;q=0.9, text/plain;q=0.8, */*;q=0.1"})
    with opener.open(request, timeout=TIMEOUT_SECONDS) as answer:
        content = answer.read(MAX_BYTES + 1)
        if len(content) > MAX_BYTES:
            raise ValueError(f"{url!r} is larger than {MAX_BYTES} bytes")
        return content.decode(answer.headers.get_content_charset() or "utf-8", errors="replace")
