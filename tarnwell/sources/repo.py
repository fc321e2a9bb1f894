"""Around a repository: its root and identity, its history, a lock for one writer, and a guard against indexing the wrong folder."""

from __future__ import annotations

import hashlib
import os
import subprocess
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MOST_FILES = 20_000
SKIP_FILE = ".tarnwell-skip"


def root_of(path: str) -> str:
    """The nearest folder upward that holds .git (a folder, or the file of a worktree); the folder itself if there is none."""
    at = Path(path).resolve()
    at = at if at.is_dir() else at.parent
    return str(next((p for p in (at, *at.parents) if (p / ".git").exists()), at))


def identity(root: str) -> str:
    """A key that all worktrees of a repository share: of the common git folder, else of the root."""
    git = Path(root) / ".git"
    shared = Path(root)
    if git.is_file():
        text = git.read_text(encoding="utf-8").strip()
        if text.startswith("gitdir:"):
            own = (Path(root) / text[7:].strip()).resolve()
            common = own / "commondir"
            shared = (own / common.read_text(encoding="utf-8").strip()).resolve() if common.exists() else own
    elif git.is_dir():
        shared = git.resolve()
    return hashlib.sha256(str(shared).encode()).hexdigest()[:16]


def index_dir(root: str, base: str) -> str:
    """Where the index of a repository lies under ``base``."""
    return f"{base.rstrip('/')}/{identity(root)}"


def guard(root: str, files: int, home: str | None = None) -> None:
    """Refuse the home folder or one above it, a folder with a skip file, and more files than an index is meant for."""
    at, own = Path(root).resolve(), Path(home or os.path.expanduser("~")).resolve()
    if at == own or at in own.parents:
        raise PermissionError(f"{at} is the home folder or above it")
    if (at / SKIP_FILE).exists():
        raise PermissionError(f"{at} has a {SKIP_FILE}")
    if files > MOST_FILES:
        raise PermissionError(f"{files} files are more than {MOST_FILES}")


def history(spark: SparkSession, root: str) -> DataFrame:
    """(commit, at, subject, files) of the commits that are no merges, newest first; a folder without git is an error."""
    mark = "\x1e"
    out = subprocess.run(["git", "-C", root, "log", "--no-merges", "--name-only", f"--format={mark}%H%x1f%ct%x1f%s"], capture_output=True, check=True)
    rows = []
    for part in out.stdout.decode("utf-8", "replace").split(mark)[1:]:
        head, *names = part.split("\n")
        commit, at, subject = head.split("\x1f", 2)
        rows.append((commit, int(at), subject, sorted(n for n in names if n)))
    return spark.createDataFrame(rows, "commit string, at long, subject string, files array<string>")


class Lock:
    """One writer at a time, by a file that only one process can create; a lock older than ``expiry`` seconds is taken over, and
    its old holder finds out by its token."""

    def __init__(self, path: str, expiry: float = 600.0):
        self.path, self.expiry, self.token = path, expiry, uuid.uuid4().hex

    def acquire(self, wait: float = 0.0) -> bool:
        end = time.monotonic() + wait
        while True:
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if self._stale():
                    stolen = f"{self.path}.{self.token}"
                    try:
                        os.rename(self.path, stolen)  # of several that try, one succeeds
                        os.unlink(stolen)
                    except FileNotFoundError:
                        pass
                    continue
                if time.monotonic() >= end:
                    return False
                time.sleep(0.05)
                continue
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                f.write(self.token)
            return True

    def _stale(self) -> bool:
        try:
            return time.time() - os.stat(self.path).st_mtime > self.expiry
        except FileNotFoundError:
            return False

    def held(self) -> bool:
        try:
            return Path(self.path).read_text(encoding="utf-8") == self.token
        except FileNotFoundError:
            return False

    def release(self) -> None:
        if self.held():
            os.unlink(self.path)

    def __enter__(self) -> Lock:
        if not self.acquire():
            raise BlockingIOError(f"{self.path} is held by another process")
        return self

    def __exit__(self, *_: object) -> None:
        self.release()
