"""The history reader against git itself, over loose objects, packs with deltas, merges and odd repositories."""

import collections
import os
import random
import subprocess

import pytest

from graphlens.operators import catalog
from graphlens.plans import index
from graphlens.sources import git
from graphlens.sources.shared import shared_dir
from graphlens.sources.snapshots import Store

ENV = {"HOME": "/nonexistent", "GIT_CONFIG_NOSYSTEM": "1", "PATH": os.environ["PATH"], "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x", "TZ": "UTC"}


def run(root, *args, who="Ann <ann@x>", at=0):
    name, email = who[:-1].split(" <")
    env = ENV | {"GIT_AUTHOR_NAME": name, "GIT_AUTHOR_EMAIL": email, "GIT_AUTHOR_DATE": f"{1_700_000_000 + at} +0200", "GIT_COMMITTER_DATE": f"{1_700_000_100 + at} +0000"}
    return subprocess.run(["git", "-C", root, *args], env=env, check=True, capture_output=True, text=True).stdout


def write(root, path, text):
    os.makedirs(os.path.dirname(f"{root}/{path}") or root, exist_ok=True)
    with open(f"{root}/{path}", "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    run(root, "init", "-q", "-b", "main")
    rnd, big = random.Random(1), "".join(f"line {k} {random.Random(k).random()}\n" for k in range(400))
    write(root, "src/big.py", big)
    write(root, "src/a.py", "def a():\n    return b()\n")
    write(root, "with space/ü.txt", "x")
    write(root, "kind", "a file")
    for k in range(12):
        if k:
            lines = big.split("\n")
            lines[rnd.randrange(400)] = f"changed {k}"
            big = "\n".join(lines)
            write(root, "src/big.py", big)
        if k == 4:
            write(root, "src/deep/er/b.py", "def b():\n    pass\n")
        if k == 6:
            os.remove(f"{root}/kind")
            write(root, "kind/now_a_folder", "y")
        if k == 7:
            os.remove(f"{root}/with space/ü.txt")
        if k == 9:
            run(root, "gc", "-q", "--aggressive", "--prune=now")
        run(root, "add", "-A")
        run(root, "commit", "-q", "-m", f"commit {k}\n\nbody <{k}>", who="Bob <bob@x>" if k % 3 else "Ann <ann@x>", at=k * 1000)
    run(root, "checkout", "-q", "-b", "side", "HEAD~3")
    write(root, "side.py", "s = 1\n")
    write(root, "src/a.py", "def a():\n    return 2\n")
    run(root, "add", "-A")
    run(root, "commit", "-q", "-m", "side", at=20_000)
    run(root, "checkout", "-q", "main")
    write(root, "src/a.py", "def a():\n    return 3\n")
    run(root, "commit", "-q", "-am", "main", at=21_000)
    subprocess.run(["git", "-C", root, "merge", "-q", "side"], env=ENV, capture_output=True)
    write(root, "src/a.py", "def a():\n    return 23\n")  # settles the conflict
    run(root, "add", "-A")
    run(root, "commit", "-q", "-m", "merge", at=22_000)
    run(root, "commit", "-q", "--allow-empty", "-m", "nothing", at=23_000)
    run(root, "tag", "-a", "v1", "-m", "tagged", "HEAD~1", at=24_000)
    return root


def logged(root, *args):
    """(hash, path) -> status by git log; merges with what differs from all parents."""
    out = {}
    text = run(root, "-c", "core.quotePath=false", "log", "--no-renames", "--name-status", "--format=@%H", *args, "HEAD")
    for line in text.splitlines():
        if line.startswith("@"):
            sha = line[1:]
        elif line:
            status, path = line.split("\t")
            out[sha, path] = {"A": "added", "M": "modified", "D": "deleted"}[status[-1]]
    return out


def test_history_equals_the_log(spark, repo):
    assert any(p.n for p in git.Repository(repo).packs)
    kinds = [git.Repository(repo).packs[0].entry(git.Repository(repo).packs[0].offset(bytes.fromhex(x)))[0] for x in run(repo, "rev-list", "--objects", "HEAD~6").split() if len(x) == 40 and git.Repository(repo).packs[0].offset(bytes.fromhex(x)) is not None]
    assert 6 in kinds  # there are deltas
    got = git.history(spark, {"r": repo}, slice_=4).collect()
    mine = {(r.hash, r.path): r.status for r in got}
    plain = logged(repo, "--no-merges")
    assert {k: v for k, v in mine.items() if k in plain} == plain
    merges = set(run(repo, "rev-list", "--merges", "HEAD").split())
    assert {k for k in mine if k not in plain} == {k for k in logged(repo, "--merges", "-c")} and {k[0] for k in mine if k not in plain} == merges
    commits = {r.hash: r for r in git.history(spark, {"r": repo}, "commits").collect()}
    for line in run(repo, "log", "--format=%H%x09%P%x09%ae%x09%an%x09%at%x09%ct%x09%s").splitlines():
        sha, parents, email, name, authored, committed, subject = line.split("\t")
        c = commits.pop(sha)
        assert (" ".join(c.parents), c.author, c.author_name, int(c.authored_at.timestamp()), int(c.committed_at.timestamp()), c.message.split("\n")[0]) == (parents, email, name, int(authored), int(committed), subject)
    assert not commits


def test_each_object_is_read(repo):
    r = git.Repository(repo)
    for sha in run(repo, "rev-list", "--objects", "--no-object-names", "HEAD").split():
        kind = run(repo, "cat-file", "-t", sha).strip()
        assert r.get(sha)[0].decode() == kind
        if kind != "tree":
            assert r.get(sha)[1] == subprocess.run(["git", "-C", repo, "cat-file", kind, sha], env=ENV, capture_output=True, check=True).stdout
    with pytest.raises(KeyError):
        r.get("0" * 40)


def test_references(repo, tmp_path):
    r = git.Repository(repo)
    for name in ("HEAD", "main", "side", "v1"):
        assert r.resolve(name) == run(repo, "rev-parse", f"{name}^{{commit}}").strip()
    run(repo, "pack-refs", "--all")
    assert git.Repository(repo).resolve("side") == r.resolve("side")
    assert r.resolve("none") is None
    bare = f"{tmp_path}/bare.git"
    subprocess.run(["git", "clone", "-q", "--bare", "--shared", repo, bare], env=ENV, check=True, capture_output=True)  # objects of another repository
    assert len(list(git.Repository(bare).reached(git.Repository(bare).resolve()))) == len(run(repo, "rev-list", "HEAD").split())
    shallow = f"{tmp_path}/shallow"
    subprocess.run(["git", "clone", "-q", "--depth", "2", f"file://{repo}", shallow], env=ENV, check=True, capture_output=True)
    assert len(list(git.Repository(shallow).reached(git.Repository(shallow).resolve()))) == len(run(shallow, "rev-list", "HEAD").split())
    tree = f"{tmp_path}/tree"
    run(repo, "worktree", "add", "-q", tree, "side")
    assert git.Repository(tree).resolve() == run(repo, "rev-parse", "side").strip()


def test_times_and_owners(spark, repo, tmp_path):
    empty = str(tmp_path)
    run(empty, "init", "-q", "-b", "main")
    times = {r.path: r for r in git.file_times(spark, {"r": repo, "e": empty}).collect()}
    for path in ("src/big.py", "src/a.py", "src/deep/er/b.py", "kind"):
        log = [int(x) for x in run(repo, "log", "--format=%ct", "--", path).split()]
        assert times[path].modification_count == len(log) and int(times[path].last_modified.timestamp()) == max(log)
    authors = collections.Counter(run(repo, "log", "--format=%ae").split())
    assert {r.repo: r.owner for r in git.owners(spark, {"r": repo, "e": empty}).collect()} == {"r": f"user:{authors.most_common(1)[0][0]}", "e": "unknown"}
    assert catalog.owners(git.history(spark, {"e": empty}, "commits")).count() == 0


def test_indexed_nodes_have_times(spark, repo):
    store = Store(spark, shared_dir(spark))
    files = spark.createDataFrame([("r", p, open(f"{repo}/{p}").read()) for p in ("src/a.py", "src/deep/er/b.py")], "repo string, path string, content string")
    times = git.file_times(spark, {"r": repo})
    index.index_all(store, files, times)
    want = {r.path: (r.last_modified, r.modification_count) for r in times.collect()}
    got = {r.id: r for r in store.load("nodes").collect()}
    for r in got.values():
        assert (r.last_modified, r.modification_count) == want.get(r.path, (None, 0)), r.id
    changed = spark.createDataFrame([("r", "modified", "src/a.py", "src/a.py")], "repo string, status string, old_path string, new_path string")
    later = times.where("path = 'src/a.py'").selectExpr("repo", "path", "last_modified", "modification_count + 1 modification_count")
    index.index_incremental(store, changed, files.where("path = 'src/a.py'"), later)
    after = {r.id: r.modification_count for r in store.load("nodes").where("path LIKE '%.py'").collect()}
    assert after["r:src/a.py"] == after["r:src/a.py::a"] == got["r:src/a.py"].modification_count + 1
    assert after["r:src/deep/er/b.py"] == got["r:src/deep/er/b.py"].modification_count


def test_changes_between_commits(spark, repo):
    r = git.Repository(repo)
    for old, new in (("HEAD~9", "HEAD"), ("HEAD~6", "HEAD~5"), ("HEAD", "HEAD")):
        a, b = run(repo, "rev-parse", old).strip(), run(repo, "rev-parse", new).strip()
        want = {tuple(x.split("\t")) for x in run(repo, "-c", "core.quotePath=false", "diff", "--no-renames", "--name-status", a, b).splitlines()}
        got = set()
        for status, before, after, blob in r.between(a, b):
            assert blob is None or blob == run(repo, "rev-parse", f"{b}:{after}").strip()
            got |= {("D", before), ("A", after)} if status == "renamed" else {(status[0].upper(), after or before)}
        assert got == want
    assert {x[2] for x in r.between(None, r.resolve())} == set(run(repo, "-c", "core.quotePath=false", "ls-tree", "-r", "--name-only", "HEAD").splitlines())


def test_a_repository_is_indexed_by_commits(spark, repo, tmp_path):
    work = f"{tmp_path}/work"
    subprocess.run(["git", "clone", "-q", repo, work], env=ENV, check=True, capture_output=True)
    store, fresh = Store(spark, shared_dir(spark)), Store(spark, shared_dir(spark))
    first = run(work, "rev-parse", "HEAD~4").strip()
    assert index.index_repository(store, work, "r", [".py"], first) == first
    n = store.view().number
    assert index.index_repository(store, work, "r", [".py"], first) == first and store.view().number == n  # nothing to do
    run(work, "mv", "src/deep/er/b.py", "src/moved.py")
    run(work, "commit", "-q", "-m", "moved", at=30_000)
    head = index.index_repository(store, work, "r", [".py"])
    assert head == run(work, "rev-parse", "HEAD").strip() == index.index_repository(fresh, work, "r", [".py"])
    rows = lambda s: sorted((r.id, r.kind, r.summary or "", str(r.last_modified), r.modification_count) for r in s.load("nodes").where("kind NOT IN ('module', 'repository')").collect())
    links = lambda s: sorted((r.source, r.target, r.kind) for r in s.load("edges").where("kind != 'contains'").collect())
    assert rows(store) == rows(fresh) and links(store) == links(fresh)
    assert ("r:src/a.py::a" in {x[0] for x in rows(store)}) and not any("deep" in x[0] for x in rows(store))
    assert [r.commit for r in store.load("repo_state").collect()] == [head]
