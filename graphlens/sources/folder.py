"""A streaming source of the changes below a folder: spark.readStream.format("folder_changes").

The offset is the number of a stored listing (path, length, time, SHA-256). To look for news, the folder is listed in order of
path and merged with the stored listing, row by row; only files whose length or time differ are read, for their hash. What
differs is written as a file of changes together with the next listing, and both are put in place by a rename that does not
overwrite, so an offset means the same rows on every read and after every restart. Tasks read ranges of the change files.

The listing and the hashes of changed files are made by one process, as a watcher's are: its time grows with the number of
files below the folder, its memory with the number of created and deleted ones.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "repo string, path string, op string, dest string, ts timestamp, event_id long, sha256 string, length long"
#: Changes that one task reads.
ROWS = 20_000


def walk(root: str, inside: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, length, time in ns) of the files below root, sorted by the parts of their paths; links are not followed."""
    try:
        found = sorted(os.scandir(os.path.join(root, inside)), key=lambda e: e.name)
    except FileNotFoundError:  # gone meanwhile
        return
    for e in found:
        path = f"{inside}/{e.name}" if inside else e.name
        if e.is_dir(follow_symlinks=False):
            yield from walk(root, path)
        elif e.is_file(follow_symlinks=False):
            with contextlib.suppress(FileNotFoundError):
                s = e.stat(follow_symlinks=False)
                yield path, s.st_size, s.st_mtime_ns


def digest(path: str) -> str | None:
    """SHA-256 of a file, read in blocks; None if it is gone."""
    h = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
    except OSError:
        return None
    return h.hexdigest()


def merged(old: Iterator[tuple], new: Iterator[tuple[str, int, int]], sha) -> Iterator[tuple[str, tuple | None, tuple | None]]:
    """(path, old row, new row) of two listings sorted alike; new rows get their hash, which unchanged ones keep."""
    key = lambda r: r[0].split("/")
    a, b = next(old, None), next(new, None)
    while a or b:
        if b is None or a and key(a) < key(b):
            yield a[0], a, None
            a = next(old, None)
        elif a is None or key(b) < key(a):
            if (h := sha(b[0])) is not None:
                yield b[0], None, (*b, h)
            b = next(new, None)
        else:
            h = a[3] if a[1:3] == b[1:3] else sha(b[0])
            yield a[0], a, None if h is None else (*b, h)
            a, b = next(old, None), next(new, None)


class State:
    """Listings and change files by number, below a folder of their own."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    def path(self, kind: str, n: int) -> str:
        return f"{self.root}/{kind}-{n:012d}.jsonl"

    def latest(self) -> int:
        return max((int(f[8:20]) for f in os.listdir(self.root) if f.startswith("listing-") and f.endswith(".jsonl")), default=0)

    def rows(self, kind: str, n: int) -> Iterator[tuple]:
        with contextlib.suppress(FileNotFoundError), open(self.path(kind, n)) as f:
            for line in f:
                yield tuple(json.loads(line))

    def put(self, kind: str, n: int, rows) -> int:
        """Writes a file that did not exist, whole or not at all; how many rows it has."""
        part, count = f"{self.path(kind, n)}.{os.getpid()}.part", 0
        with open(part, "w") as f:
            for r in rows:
                f.write(json.dumps(r) + "\n")
                count += 1
            f.flush()
            os.fsync(f.fileno())
        with contextlib.suppress(FileExistsError):  # another reader of this state was faster
            os.link(part, self.path(kind, n))
        os.unlink(part)
        return count

    def advance(self, folder: str) -> int:
        """The number of the latest listing, after a new one if anything has changed. Number 0 is the empty listing."""
        n = self.latest()
        created: list[tuple] = []
        deleted: list[tuple] = []
        modified: list[tuple] = []
        spool = f"{self.root}/next.{os.getpid()}.part"
        with open(spool, "w") as out:
            for path, a, b in merged(self.rows("listing", n), walk(folder), lambda p: digest(os.path.join(folder, p))):
                if b is not None:
                    out.write(json.dumps(b) + "\n")
                if a is None:
                    created.append((path, *b[1:]))
                elif b is None:
                    deleted.append((path, *a[1:]))
                elif a[1] != b[1] or a[3] != b[3]:  # a new time alone is no change
                    modified.append((path, *b[1:]))
        changes = list(self._renamed(created, deleted)) + [(p, "modified", None, t, h, size) for p, size, t, h in modified]
        if changes:
            # the changes first: a listing is only there with its changes
            self.put("changes", n + 1, sorted(changes))
            with contextlib.suppress(FileExistsError):
                os.link(spool, self.path("listing", n + 1))
        os.unlink(spool)
        return self.latest()

    @staticmethod
    def _renamed(created: list[tuple], deleted: list[tuple]) -> Iterator[tuple]:
        """A created file with the hash of a deleted one is that one moved, in order of their paths; empty files are not."""
        by: dict[str, list[tuple]] = {}
        for d in reversed(deleted):
            by.setdefault(d[3], []).append(d)
        moved = set()
        for path, size, t, h in created:
            if size and by.get(h):
                old = by[h].pop()[0]
                moved.add(old)
                yield old, "moved", path, t, h, size
            else:
                yield path, "created", None, t, h, size
        for path, size, t, h in deleted:
            if path not in moved:
                yield path, "deleted", None, t, h, size

    def forget(self, n: int) -> None:
        """Removes what a stream that has finished number n never reads again."""
        for f in os.listdir(self.root):
            if f.endswith(".jsonl") and int(f[-18:-6]) < n + f.startswith("changes-"):
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(f"{self.root}/{f}")


class _Slice(InputPartition):
    def __init__(self, n: int, lo: int, hi: int):
        self.n, self.lo, self.hi = n, lo, hi


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.repo, self.state = options["path"].removeprefix("file://"), options.get("repo", ""), State(options["state"].removeprefix("file://"))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": self.state.advance(self.folder)}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        out = []
        for n in range(start["listing"] + 1, end["listing"] + 1):
            count = sum(1 for _ in self.state.rows("changes", n))
            out += [_Slice(n, lo, min(count, lo + ROWS)) for lo in range(0, count, ROWS)]
        return out

    def read(self, part: _Slice) -> Iterator[tuple]:
        from datetime import datetime, timezone

        for k, (path, op, dest, ns, sha, size) in enumerate(self.state.rows("changes", part.n)):
            if part.lo <= k < part.hi:
                yield self.repo, path, op, dest, datetime.fromtimestamp(ns // 1000 / 1e6, timezone.utc), (part.n << 40) + k, sha, size

    def commit(self, end: dict) -> None:
        self.state.forget(end["listing"])


class FolderChanges(DataSource):
    """Options: path (the folder), state (a folder of the source's own, on storage that all tasks reach), repo (a name for the rows).

    op is created, modified, deleted or moved (path to dest); ts is the file's time (of a deleted one, its last known). The
    first listing is all created. A stream that starts anew on a state that others have used begins at what they left.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def changes_below(spark: SparkSession, folder: str, state: str, repo: str = ""):
    """The stream of changes below folder."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("path", folder).option("state", state).option("repo", repo).load()
