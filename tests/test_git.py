"""Refs of repositories that the git program has made, loose and packed with deltas."""

import hashlib
import os
import subprocess

import pytest

from siltstone.api import Engine
from siltstone.sources import files, gitobjects

ENV = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": "/dev/null"}


def git(at, *args):
    return subprocess.run(["git", "-C", str(at), *args], check=True, capture_output=True, env=ENV, timeout=60).stdout


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "repo"
    at.mkdir()
    git(at, "init", "-q", "-b", "main")
    (at / "src" / "deep").mkdir(parents=True)
    long = [f"line {i} of a long file\n" for i in range(800)]
    for n in range(12):  # versions of one file become deltas of one another
        long[n * 7] = f"changed {n}\n"
        (at / "src" / "big.py").write_text("".join(long))
        (at / "src" / f"f{n}.py").write_text(f"def only_main_{n}():\n    return {n}\n")
        git(at, "add", "-A")
        git(at, "commit", "-qm", f"c{n}")
    git(at, "checkout", "-q", "-b", "rel")
    (at / "src" / "deep" / "é.py").write_text("def only_rel():\r\n    return 1\r\n")
    (at / "src" / "f3.py").unlink()
    (at / "huge.py").write_text("x" * (files.MAX_REF_BYTES + 1))
    (at / "data.bin").write_bytes(b"\x00\xff" * 50)
    (at / "run.sh").write_text("echo\n")
    (at / "run.sh").chmod(0o755)
    (at / "link.py").symlink_to("src/big.py")
    for d in range(70):
        (at / "many" / f"d{d}" / "x").mkdir(parents=True)
        (at / "many" / f"d{d}" / "x" / "m.py").write_text(f"m = {d}\n")
    git(at, "add", "-A")
    git(at, "commit", "-qm", "rel")
    git(at, "tag", "-a", "v1", "-m", "tagged")
    git(at, "checkout", "-q", "main")
    return at


def truth(at, ref):
    out = {}
    for line in git(at, "ls-tree", "-r", "-z", "--full-tree", ref).decode().split("\0"):
        if line:
            head, path = line.split("\t")
            out[path] = (head.split()[0], head.split()[2])
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_any_ref(spark, repo, packed):
    if packed:
        git(repo, "gc", "-q", "--aggressive", "--prune=now")
        assert b"chain length" in git(repo, "verify-pack", "-v", *map(str, (repo / ".git/objects/pack").glob("*.idx")))
    root = f"file://{repo}"
    for ref in ("main", "rel", "v1", "refs/heads/rel", git(repo, "rev-parse", "main~4").decode().strip()):
        want = truth(repo, ref)
        listed = gitobjects.list_ref(spark, root, ref)
        assert {r.item_path: (r.mode, r.object) for r in listed.collect()} == want, ref
        for r in gitobjects.read_objects(listed, gitobjects.object_folders(spark, root)).collect():
            raw = git(repo, "cat-file", "blob", want[r.item_path][1])
            assert (r.size, r.content) == (len(raw), raw.decode("utf-8", "replace")), r.item_path
    rows = {r.item_path: r for r in gitobjects.read_ref(spark, root, "rel", files.compile_rules(["many/d1*/"])).collect()}
    assert "src/deep/é.py" in rows and not {"huge.py", "link.py", "data.bin", "many/d1/x/m.py", "src/f3.py"} & set(rows) and "many/d2/x/m.py" in rows
    assert rows["src/deep/é.py"].hash == hashlib.sha256(b"def only_rel():\n    return 1\n").hexdigest()
    with pytest.raises(LookupError):
        gitobjects.list_ref(spark, root, "nowhere")


def test_a_worktree_and_alternates(spark, repo, tmp_path):
    git(repo, "worktree", "add", "-q", str(tmp_path / "tree"), "rel")
    git(tmp_path, "clone", "-q", "--shared", str(repo), "clone")
    for root, ref in ((tmp_path / "tree", "main"), (tmp_path / "clone", "origin/rel")):
        assert {r.item_path for r in gitobjects.list_ref(spark, f"file://{root}", ref).collect()} == set(truth(repo, ref.removeprefix("origin/")))


def test_deltas():
    base = b"abcdefgh" * 10_000
    delta = b"\x80\xf1\x04" + b"\x83\x80\x04" + b"\x80" + b"\x03xyz"  # a copy without any byte is of 64 KiB from the start
    assert gitobjects.apply_delta(base, delta) == base[:0x10000] + b"xyz"
    with pytest.raises(ValueError):
        gitobjects.apply_delta(base[1:], delta)


def test_engine_indexes_what_is_not_checked_out(spark, repo, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/index", dims=16)
    e.registry.add_project("p")
    e.registry.add_source("p", {"id": "s", "type": "code", "root": f"file://{repo}", "ignore": ["many/", "src/big.py"]})
    e.index_source("p", "s", "rel")
    assert e.last_indexed_sha("p", "s", "rel") == git(repo, "rev-parse", "rel").decode().strip()
    names = {r.symbol_name for r in e.lookup_symbol("p", "only_rel").collect()} | {r.symbol_name for r in e.lookup_symbol("p", "only_main_3").collect()}
    assert names == {"only_rel"}
    assert e.search_code("p", "only_rel", 1, branch="rel").first().item_path == "src/deep/é.py"
    done = e.call("index_ephemeral", {"project": "p", "source": "s", "ref": "main"})
    assert done["label"] == "_ephemeral/main" and {r.symbol_name for r in e.lookup_symbol("p", "only_main_3").collect()} == {"only_main_3"}
    with pytest.raises(LookupError):
        e.index_source("p", "s", "nowhere")
