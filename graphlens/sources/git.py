"""Commit histories of git repositories as rows: spark.read.format("git_history"), straight from loose objects and packs.

The commits that a reference reaches are listed first, from their objects alone; tasks take slices of them and compare each
one's tree with its parents', entering only subtrees that differ. Packs are mapped into memory and looked up by their index.
"""

from __future__ import annotations

import functools
import json
import mmap
import os
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: rows=commits: one for each commit. rows=paths: one for each path that a commit changed.
COMMITS = "repo string, hash string, parents array<string>, author string, author_name string, authored_at timestamp, committed_at timestamp, message string"
PATHS = f"{COMMITS}, path string, status string"
BETWEEN = "repo string, status string, old_path string, new_path string, blob string"
#: Commits that one task reads.
SLICE = 500
_KINDS = {1: b"commit", 2: b"tree", 3: b"blob", 4: b"tag"}
_TREE = 0o40000
_SUBMODULE = 0o160000


def _number(data, at: int) -> tuple[int, int]:
    """A number of 7 bits a byte, least first, and where it ends."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if not b & 128:
            return value, at


def patched(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base."""
    size, at = _number(delta, 0)
    if size != len(base):
        raise ValueError("a delta of another base")
    size, at = _number(delta, at)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:  # copy: up to 4 bytes of offset and 3 of length, those that are not 0
            where = length = 0
            for k in range(4):
                if op >> k & 1:
                    where |= delta[at] << 8 * k
                    at += 1
            for k in range(3):
                if op >> 4 + k & 1:
                    length |= delta[at] << 8 * k
                    at += 1
            length = length or 0x10000
            out += base[where : where + length]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("a reserved step in a delta")
    if len(out) != size:
        raise ValueError("a delta of another length")
    return bytes(out)


class Pack:
    """A pack and its index (version 2)."""

    def __init__(self, index: str):
        with open(index, "rb") as f:
            self.index = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        with open(index[:-4] + ".pack", "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.index[:8] != b"\xfftOc\0\0\0\2":
            raise ValueError(f"{index} is no index of version 2")
        self.fan = struct.unpack(">256I", self.index[8 : 8 + 1024])
        self.n = self.fan[255]

    def offset(self, sha: bytes) -> int | None:
        """Where an object starts: the fan-out by its first byte, then a search by halves."""
        lo, hi = self.fan[sha[0] - 1] if sha[0] else 0, self.fan[sha[0]]
        names = 8 + 1024
        while lo < hi:
            mid = (lo + hi) // 2
            own = self.index[names + 20 * mid : names + 20 * mid + 20]
            if own == sha:
                small = names + 24 * self.n
                (at,) = struct.unpack(">I", self.index[small + 4 * mid : small + 4 * mid + 4])
                if at >> 31:
                    large = small + 4 * self.n + 8 * (at & 0x7FFFFFFF)
                    (at,) = struct.unpack(">Q", self.index[large : large + 8])
                return at
            lo, hi = (mid + 1, hi) if own < sha else (lo, mid)
        return None

    def entry(self, at: int) -> tuple[int, int | bytes | None, bytes]:
        """(type, base: place, name or None, content) of the entry at a place."""
        start, first = at, self.data[at]
        kind, more, at = first >> 4 & 7, first & 128, at + 1
        if more:
            _, at = _number(self.data, at)
        base: int | bytes | None = None
        if kind == 6:  # the base's place, counted back; each further byte adds one
            b = self.data[at]
            at += 1
            back = b & 127
            while b & 128:
                b = self.data[at]
                at += 1
                back = (back + 1 << 7) | b & 127
            base = start - back
        elif kind == 7:
            base, at = self.data[at : at + 20], at + 20
        inflate, out = zlib.decompressobj(), []
        while not inflate.eof:
            out.append(inflate.decompress(self.data[at : at + (1 << 16)]))
            at += 1 << 16
        return kind, base, b"".join(out)


class Repository:
    """Objects and references below a work tree or a bare repository."""

    def __init__(self, path: str):
        path = path.removeprefix("file://")
        dot = os.path.join(path, ".git")
        if os.path.isfile(dot):  # a work tree elsewhere
            with open(dot) as f:
                dot = os.path.join(path, f.read().split(":", 1)[1].strip())
        self.git = dot if os.path.isdir(dot) else path
        common = os.path.join(self.git, "commondir")
        self.common = os.path.join(self.git, open(common).read().strip()) if os.path.exists(common) else self.git
        self.roots = [os.path.join(self.common, "objects")]
        for root in self.roots:  # grows while it is read
            borrowed = os.path.join(root, "info", "alternates")
            if os.path.exists(borrowed):
                with open(borrowed) as f:
                    self.roots += [os.path.join(root, x.strip()) for x in f if x.strip() and not x.startswith("#")]
        self.packs = [Pack(os.path.join(root, "pack", x)) for root in self.roots if os.path.isdir(os.path.join(root, "pack")) for x in sorted(os.listdir(os.path.join(root, "pack"))) if x.endswith(".idx")]
        self.get = functools.lru_cache(4096)(self._get)

    def _get(self, sha: str) -> tuple[bytes, bytes]:
        """(type, content) of an object; KeyError without it."""
        for root in self.roots:
            try:
                with open(f"{root}/{sha[:2]}/{sha[2:]}", "rb") as f:
                    head, _, body = zlib.decompress(f.read()).partition(b"\0")
            except FileNotFoundError:
                continue
            return head.split()[0], body
        for pack in self.packs:
            if (at := pack.offset(bytes.fromhex(sha))) is not None:
                return self._packed(pack, at)
        raise KeyError(sha)

    def _packed(self, pack: Pack, at: int) -> tuple[bytes, bytes]:
        """An object of a pack, over as many deltas as there are."""
        deltas: list[bytes] = []
        while True:
            kind, base, body = pack.entry(at)
            if kind in _KINDS:
                found = _KINDS[kind], body
                break
            deltas.append(body)
            if isinstance(base, bytes):
                place = pack.offset(base)
                if place is None:
                    found = self.get(base.hex())
                    break
                at = place
            else:
                at = base
        name, body = found
        for delta in reversed(deltas):
            body = patched(body, delta)
        return name, body

    def resolve(self, name: str = "HEAD") -> str | None:
        """The commit that a reference, a tag or a full hash names; None for a branch without commits."""
        for _ in range(10):
            if len(name) == 40 and all(c in "0123456789abcdef" for c in name):
                kind, body = self.get(name)
                if kind != b"tag":
                    return name
                name = body.split(b"\n", 1)[0].split()[1].decode()
                continue
            text = self._reference(name)
            if text is None:
                return None
            name = text.removeprefix("ref:").strip()
        raise ValueError(f"{name} names no commit")

    def _reference(self, name: str) -> str | None:
        for ref in (name, f"refs/heads/{name}", f"refs/tags/{name}", f"refs/remotes/{name}"):
            for root in (self.git, self.common):
                path = os.path.join(root, ref)
                if os.path.isfile(path):
                    with open(path) as f:
                        return f.read().strip()
            packed = os.path.join(self.common, "packed-refs")
            if os.path.exists(packed):
                with open(packed) as f:
                    for line in f:
                        if not line.startswith(("#", "^")) and line.split()[1:] == [ref]:
                            return line.split()[0]
        return None

    @functools.cached_property
    def shallow(self) -> set[str]:
        """Commits whose parents are not there."""
        path = os.path.join(self.common, "shallow")
        return set(open(path).read().split()) if os.path.exists(path) else set()

    def commit(self, sha: str) -> dict:
        kind, body = self.get(sha)
        if kind != b"commit":
            raise ValueError(f"{sha} is a {kind.decode()}")
        head, _, message = body.partition(b"\n\n")
        out: dict = {"hash": sha, "parents": [], "message": message.decode("utf-8", "replace").strip()}
        for line in head.split(b"\n"):
            key, _, value = line.partition(b" ")
            if key == b"tree":
                out["tree"] = value.decode()
            elif key == b"parent":
                out["parents"].append(value.decode())
            elif key in (b"author", b"committer"):
                who, _, when = value.rpartition(b"> ")
                name, _, email = who.partition(b"<")
                seconds = int(when.split()[0]) if when.split() else 0
                out[key.decode()] = (name.decode("utf-8", "replace").strip(), email.decode("utf-8", "replace"), datetime.fromtimestamp(seconds, timezone.utc))
        if sha in self.shallow:
            out["parents"] = []
        return out

    def reached(self, start: str) -> Iterator[str]:
        """Each commit that start reaches, itself first."""
        seen, open_ = {start}, [start]
        while open_:
            sha = open_.pop()
            yield sha
            for p in self.commit(sha)["parents"]:
                if p not in seen:
                    seen.add(p)
                    open_.append(p)

    def tree(self, sha: str | None) -> dict[bytes, tuple[int, str]]:
        """Name -> (mode, hash) of a tree's entries."""
        out, at = {}, 0
        body = self.get(sha)[1] if sha else b""
        while at < len(body):
            space, end = body.index(b" ", at), body.index(b"\0", at)
            out[body[space + 1 : end]] = int(body[at:space], 8), body[end + 1 : end + 21].hex()
            at = end + 21
        return out

    def changes(self, old: str | None, new: str | None, inside: bytes = b"") -> Iterator[tuple[bytes, str]]:
        """(path, added, modified or deleted) between two trees; equal subtrees are not entered, submodules are left out."""
        if old == new:
            return
        a, b = self.tree(old), self.tree(new)
        for name in sorted(a.keys() | b.keys()):
            x, y = a.get(name), b.get(name)
            if x == y:
                continue
            path = inside + name
            was, now = x and x[0] == _TREE, y and y[0] == _TREE
            if was or now:
                yield from self.changes(x[1] if was else None, y[1] if now else None, path + b"/")
            file_x, file_y = x if x and not was and x[0] != _SUBMODULE else None, y if y and not now and y[0] != _SUBMODULE else None
            if file_x or file_y:
                yield path, "modified" if file_x and file_y else "added" if file_y else "deleted"

    def blob(self, tree: str, path: bytes) -> str:
        """The hash of a file below a tree."""
        *folders, name = path.split(b"/")
        for folder in folders:
            tree = self.tree(tree)[folder][1]
        return self.tree(tree)[name][1]

    def between(self, old: str | None, new: str) -> Iterator[tuple[str, str | None, str | None, str | None]]:
        """(status, old path, new path, hash) of the files that differ between two commits; a deleted and an added file with
        the same content are one renamed, in order of their paths."""
        text = lambda b: b.decode("utf-8", "replace")
        a, b = self.commit(old)["tree"] if old else None, self.commit(new)["tree"]
        gone: dict[str, list[bytes]] = {}
        added = []
        for path, status in self.changes(a, b):
            if status == "modified":
                yield "modified", text(path), text(path), self.blob(b, path)
            elif status == "added":
                added.append((path, self.blob(b, path)))
            else:
                gone.setdefault(self.blob(a, path), []).append(path)
        for path, sha in added:
            if gone.get(sha):
                yield "renamed", text(gone[sha].pop(0)), text(path), sha
            else:
                yield "added", None, text(path), sha
        for paths in gone.values():
            for path in paths:
                yield "deleted", text(path), None, None

    def changed_paths(self, commit: dict) -> list[tuple[str, str]]:
        """Paths that differ from each parent's, with their status against the first; so a merge has only what it settles itself."""
        tree = lambda sha: self.commit(sha)["tree"]
        first, *others = commit["parents"] or [None]
        own = list(self.changes(tree(first) if first else None, commit["tree"]))
        for p in others:
            there = {path for path, _ in self.changes(tree(p), commit["tree"])}
            own = [x for x in own if x[0] in there]
        return [(path.decode("utf-8", "replace"), status) for path, status in own]


class _Slice(InputPartition):
    def __init__(self, repo: str, path: str, commits: list[str]):
        self.repo, self.path, self.commits = repo, path, commits


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repos = json.loads(options["repos"]) if "repos" in options else {options.get("repo", ""): options["path"]}
        self.start, self.rows, self.slice = options.get("start", "HEAD"), options.get("rows", "paths"), int(options.get("slice", SLICE))
        self.since = options.get("since") or None

    def partitions(self) -> list[_Slice]:
        out = []
        for repo, path in self.repos.items():
            r = Repository(path)
            start = r.resolve(self.start)
            if self.rows == "between":  # a comparison of two trees is one slice
                out += [_Slice(repo, path, [start])] if start else []
                continue
            commits = list(r.reached(start)) if start else []
            out += [_Slice(repo, path, commits[k : k + self.slice]) for k in range(0, len(commits), self.slice)]
        return out or [_Slice("", "", [])]

    def read(self, part: _Slice) -> Iterator[tuple]:
        if not part.commits:
            return
        r = Repository(part.path)
        if self.rows == "between":
            for row in r.between(self.since, part.commits[0]):
                yield part.repo, *row
            return
        for sha in part.commits:
            c = r.commit(sha)
            name, email, authored = c["author"]
            row = part.repo, sha, c["parents"], email, name, authored, c["committer"][2], c["message"]
            if self.rows == "paths":
                for path, status in r.changed_paths(c):
                    yield (*row, path, status)
            else:
                yield row


class GitHistory(DataSource):
    """Options: path and repo, or repos (JSON: name -> path); start (a reference, HEAD); rows (paths, commits, or between: the files
    that differ between the commit `since`, or nothing, and start); slice.

    Rows of paths hold a commit's message once for each path. Paths and texts that are no UTF-8 have U+FFFD. A shallow clone's
    last commits count as first ones. Repositories with SHA-256 names are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return {"paths": PATHS, "commits": COMMITS, "between": BETWEEN}[self.options.get("rows", "paths")]

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def history(spark: SparkSession, repos: dict[str, str], rows: str = "paths", start: str = "HEAD", slice_: int = SLICE) -> DataFrame:
    """Rows of commits, or of paths that commits changed, of repositories (name -> folder)."""
    spark.dataSource.register(GitHistory)
    return spark.read.format("git_history").option("repos", json.dumps(repos)).option("rows", rows).option("start", start).option("slice", slice_).load()


def changed_between(spark: SparkSession, repo: str, path: str, since: str | None, start: str = "HEAD") -> DataFrame:
    """repo, status, old_path, new_path, blob: what differs between two commits, as plans.index.index_incremental takes it."""
    spark.dataSource.register(GitHistory)
    reader = spark.read.format("git_history").option("repos", json.dumps({repo: path})).option("rows", "between").option("start", start)
    return (reader.option("since", since) if since else reader).load()


def contents(rows: DataFrame, path: str, limit_bytes: int = 500 << 10) -> DataFrame:
    """repo, path, content of rows(repo, new_path, blob), read from the objects by the tasks; larger files and those that are no UTF-8 are left out."""

    def read(batches):
        import pyarrow as pa

        own = None
        for batch in batches:
            own, out = own or Repository(path), []
            for repo, new_path, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = own.get(blob)[1]
                if len(body) <= limit_bytes:
                    try:
                        out.append((repo, new_path, body.decode()))
                    except UnicodeDecodeError:
                        continue
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] or [pa.array([], pa.string())] * 3, names=["repo", "path", "content"])

    wanted = rows.where("blob IS NOT NULL").select("repo", "new_path", "blob")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return wanted.repartition(parts, "blob").mapInArrow(read, "repo string, path string, content string")


def file_times(spark: SparkSession, repos: dict[str, str], cap: int = 50) -> DataFrame:
    """repo, path, last_modified, modification_count of each path that the histories name."""
    from ..operators.temporal import file_history

    return file_history(history(spark, repos).select("repo", "path", "committed_at"), cap)


def owners(spark: SparkSession, repos: dict[str, str]) -> DataFrame:
    """repo, owner of each repository, `unknown` without commits."""
    from ..operators.catalog import every_owner

    names = spark.createDataFrame([(r,) for r in repos], "repo string")
    return every_owner(names, history(spark, repos, "commits").select("repo", F.col("author"), "committed_at", "hash"))
