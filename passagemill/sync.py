"""Bringing the index up to date: one run, its lock between processes, and a background job."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path


class SyncBusyError(RuntimeError):
    """Another run holds the lock."""


def lasted(seconds: float) -> str:
    """``XhMMmSSs``, ``XmSSs`` or ``Xs``."""
    m, s = divmod(int(seconds), 60)
    h, m = divmod(m, 60)
    return f"{h}h{m:02}m{s:02}s" if h else f"{m}m{s:02}s" if m else f"{s}s"


def _holder(path: Path) -> str:
    try:
        said = json.loads(path.read_text())
        age = time.time() - float(said["started"])
        return f"process {said['pid']}" + (f", for {lasted(age)}" if age >= 0 else "")
    except (OSError, ValueError, KeyError, TypeError):
        return "another process"


@contextlib.contextmanager
def sync_lock(folder: str) -> Iterator[None]:
    """Held by one process at a time; freed by the system if its process dies.  Only a lock that is
    taken refuses; where locks cannot be had at all, the run goes on without."""
    path = Path(folder.removeprefix("file://")) / ".sync.lock"
    try:
        path.parent.mkdir(parents=True, exist_ok=True)
        handle = path.open("a+")
    except OSError:
        yield
        return
    try:
        fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
    except BlockingIOError as e:
        handle.close()
        raise SyncBusyError(f"the index is being brought up to date by {_holder(path)}") from e
    except OSError:
        handle.close()
        yield
        return
    try:
        handle.seek(0)
        handle.truncate()
        handle.write(json.dumps({"pid": os.getpid(), "started": time.time()}))
        handle.flush()
        yield
    finally:
        with contextlib.suppress(OSError):
            handle.seek(0)
            handle.truncate()
            fcntl.flock(handle, fcntl.LOCK_UN)
        handle.close()


def _now() -> str:
    return datetime.now(UTC).isoformat()


@dataclass
class SyncJob:
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    state: str = "pending"
    started_at: str = field(default_factory=_now)
    finished_at: str | None = None
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("scanned", "ingested", "skipped", "deleted", "unreadable", "failed"), 0))
    errors: list[dict] = field(default_factory=list)
    error: str | None = None

    def to_dict(self) -> dict:
        return {"jobId": self.job_id, "state": self.state, "startedAt": self.started_at, "finishedAt": self.finished_at, "counts": dict(self.counts), "errors": list(self.errors), "error": self.error}


class SyncManager:
    """At most one background run; only the latest job is remembered."""

    def __init__(self, folder: str, run: Callable[[str | None], tuple[dict, list]]):
        self.folder, self.run = folder, run
        self.job: SyncJob | None = None
        self._guard = threading.Lock()
        self._thread: threading.Thread | None = None

    def start(self, scope: str | None = None) -> SyncJob:
        with self._guard:
            if self._thread is not None and self._thread.is_alive():
                raise SyncBusyError("a run is already going on in this process")
            held = contextlib.ExitStack()
            held.enter_context(sync_lock(self.folder))  # taken here, so that a refusal reaches the caller
            job = self.job = SyncJob(state="running")
            self._thread = threading.Thread(target=self._work, args=(job, scope, held), daemon=True)
            self._thread.start()
            return job

    def _work(self, job: SyncJob, scope: str | None, held: contextlib.ExitStack) -> None:
        state, error = "succeeded", None
        try:
            job.counts, job.errors = self.run(scope)
        except Exception as e:  # noqa: BLE001 - the job records what ended it
            state, error = "failed", str(e)
        finally:
            held.close()  # before the end is published: who sees it may start the next run
            job.error, job.finished_at, job.state = error, _now(), state

    def status(self, job_id: str | None = None) -> SyncJob:
        if self.job is None or (job_id is not None and job_id != self.job.job_id):
            raise KeyError(f"no such job: {job_id}")
        return self.job

    def wait(self, timeout: float | None = None) -> None:
        if self._thread is not None:
            self._thread.join(timeout)
