"""What may be fetched or read: URLs and paths."""

from __future__ import annotations

import ipaddress
import os
import socket
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SecurityError(Exception):
    """A URL or path that must not be touched."""


class URLResolutionError(Exception):
    """A host name that has no address: a failed fetch, not a refused one."""


class BlockedFetchError(SecurityError):
    """A refusal while fetching: of the URL itself or of one it led to."""

    def __init__(self, url: str, reason: str):
        super().__init__(f"{reason} (blocked URL: {url})")
        self.url, self.reason = url, reason


RESOLVE_SECONDS = 5.0

#: In the order in which a verdict is given: the narrower kinds are private, too.
KINDS = ("loopback", "link-local", "unspecified", "private", "reserved")


def blocked_kind(address: str) -> str | None:
    """Why an address must not be fetched from; None if it may be."""
    ip = ipaddress.ip_address(address)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return next((k for k in KINDS if getattr(ip, "is_" + k.replace("-", "_"))), None)


def resolve_host(host: str) -> list[str]:
    """All addresses of a host name; the wait for them is bounded."""
    pool = ThreadPoolExecutor(max_workers=1)
    try:
        found = pool.submit(socket.getaddrinfo, host, None, type=socket.SOCK_STREAM).result(timeout=RESOLVE_SECONDS)
    except TooLate as e:
        raise URLResolutionError(f"no answer for host {host!r} within {RESOLVE_SECONDS:g} s") from e
    except OSError as e:
        raise URLResolutionError(f"host {host!r} cannot be resolved: {e}") from e
    finally:
        pool.shutdown(wait=False)
    if not found:
        raise URLResolutionError(f"host {host!r} has no address")
    return [x[4][0] for x in found]


def literal_address(host: str) -> str | None:
    """The address a host is written as: dotted, IPv6, or one of the old forms (decimal, hexadecimal,
    fewer parts) that name resolution takes as well; the name of this machine counts as its address."""
    if host == "localhost" or host.endswith(".localhost"):
        return "127.0.0.1"
    try:
        return str(ipaddress.ip_address(host.split("%")[0]))
    except ValueError:
        pass
    parts = host.rstrip(".").split(".")
    if all(p[:1].isdigit() for p in parts) and host.isascii():
        try:
            return socket.inet_ntoa(socket.inet_aton(host.rstrip(".")))
        except OSError:
            return None
    return None


def verdict(url: str | None, allow_private: bool = False, resolve: Callable[[str], Sequence[str]] | None = None) -> str:
    """``ok``, or why the URL is refused.  Names other than this machine's are only judged where a
    resolver is given; one bad address of several refuses."""
    try:
        parts = urlsplit(url or "")
        scheme, host = parts.scheme.lower(), parts.hostname
    except ValueError:
        return "malformed"
    if scheme not in ("http", "https"):
        return f"scheme {scheme or 'none'}"
    if allow_private:
        return "ok"
    if not host:
        return "no host"
    host = unicodedata.normalize("NFKC", host).replace("。", ".").lower()  # as name resolution reads full-width digits and dots
    written = literal_address(host)
    kind = next((k for k in map(blocked_kind, [written] if written else resolve(host) if resolve else []) if k), None)
    return f"{kind} address" if kind else "ok"


def check_url(url: str, allow_private: bool = False, resolve: Callable[[str], Sequence[str]] | None = resolve_host) -> None:
    """Refuse a URL that must not be fetched; names are resolved unless ``resolve`` is None."""
    found = verdict(url, allow_private, resolve)
    if found != "ok":
        raise SecurityError(f"refusing {url!r}: {found}")


def check_path(path: str, roots: Sequence[str]) -> str:
    """The real path, if it lies in one of the roots."""
    real = os.path.realpath(path)
    if not os.path.isabs(path) or not any(real == r or real.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, roots)):
        raise SecurityError(f"{path!r} is outside the document roots")
    return real


def url_verdicts(urls: DataFrame, allow_private: bool = False) -> DataFrame:
    """``(url, verdict)`` for a table of ``url``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([verdict(u, allow_private) for u in batch.column(0).to_pylist()], type=pa.string())], names=["url", "verdict"])

    return urls.select(F.col("url").cast("string")).mapInArrow(run, "url string, verdict string")
