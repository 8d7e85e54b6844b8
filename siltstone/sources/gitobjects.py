"""Files of any ref of a repository, read from its objects: no checkout, no git program.

A ref names a commit, a commit its tree, a tree its entries.  The driver reads
the first levels of the tree and deals what is below to tasks, and the files
found are dealt to tasks again, which read their contents.  An object is a
compressed file of its own or stands in a pack: the pack's index is asked by the
fan-out of the hash's first byte, of which only that byte's stretch is read, and
chains of deltas are resolved from their base on.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T

from . import files, repository

#: Trees that the driver lists before tasks do, files that a task reads, bytes read of a pack at a time, and objects that a reader remembers.
SPREAD, SLICE_FILES, STRETCH, REMEMBERED = 64, 500, 1 << 16, 512

# Kinds of objects in a pack.
COMMIT, TREE, BLOB, TAG, OFFSET_DELTA, HASH_DELTA = 1, 2, 3, 4, 6, 7
KINDS = {b"commit": COMMIT, b"tree": TREE, b"blob": BLOB, b"tag": TAG}
FOLDER_MODE, PACK_INDEX_HEAD = "40000", b"\xfftOc\x00\x00\x00\x02"


def _size(raw: bytes, at: int) -> tuple[int, int]:
    """(number, next place) of seven bits a byte, least first."""
    out = shift = 0
    while True:
        out |= (raw[at] & 127) << shift
        shift += 7
        at += 1
        if raw[at - 1] < 128:
            return out, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: stretches copied from it, and new bytes."""
    n, at = _size(delta, 0)
    if n != len(base):
        raise ValueError("a delta does not fit its base")
    n, at = _size(delta, at)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if not op & 128:
            out += delta[at : at + op]
            at += op
            continue
        start = length = 0
        for bit in range(7):
            if op >> bit & 1:
                if bit < 4:
                    start |= delta[at] << 8 * bit
                else:
                    length |= delta[at] << 8 * (bit - 4)
                at += 1
        length = length or 0x10000
        out += base[start : start + length]
    if len(out) != n:
        raise ValueError("a delta makes another length than it says")
    return bytes(out)


class _Pack:
    """A pack and its index, both read in stretches."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, width: int):
        self.index, self.width = fs.open_input_file(path), width
        self.data = fs.open_input_file(path.removesuffix(".idx") + ".pack")
        head = self.index.read_at(8 + 1024, 0)
        if head[:8] != PACK_INDEX_HEAD:
            raise ValueError(f"{path}: an index of another version")
        self.fan = [0] + [int.from_bytes(head[8 + 4 * i : 12 + 4 * i], "big") for i in range(256)]
        self.names: dict[int, list[bytes]] = {}

    def _number(self, at: int, width: int) -> int:
        return int.from_bytes(self.index.read_at(width, at), "big")

    def place(self, name: bytes) -> int | None:
        """Where an object stands in the pack."""
        first, past = self.fan[name[0]], self.fan[name[0] + 1]
        if name[0] not in self.names:
            raw = self.index.read_at((past - first) * self.width, 1032 + first * self.width)
            self.names[name[0]] = [raw[i : i + self.width] for i in range(0, len(raw), self.width)]
        held = self.names[name[0]]
        i = bisect_left(held, name)
        if i == len(held) or held[i] != name:
            return None
        n = self.fan[256]
        offsets = 1032 + n * (self.width + 4)
        found = self._number(offsets + 4 * (first + i), 4)
        return found if found < 1 << 31 else self._number(offsets + 4 * n + 8 * (found - (1 << 31)), 8)

    def entry(self, at: int) -> tuple[int, bytes | int | None, bytes]:
        """(kind, base of a delta: its hash or its place, contents) of what stands at a place."""
        head = self.data.read_at(64 + self.width, at)
        kind, past = head[0] >> 4 & 7, 1
        while head[past - 1] & 128:
            past += 1
        base: bytes | int | None = None
        if kind == HASH_DELTA:
            base = head[past : past + self.width]
            past += self.width
        elif kind == OFFSET_DELTA:
            back = head[past] & 127
            while head[past] & 128:
                past += 1
                back = (back + 1) << 7 | head[past] & 127
            past += 1
            base = at - back
        zipped, out, at = zlib.decompressobj(), bytearray(), at + past
        while not zipped.eof:
            raw = self.data.read_at(STRETCH, at)
            if not raw:
                raise ValueError("a pack is cut short")
            out += zipped.decompress(raw)
            at += STRETCH
        return kind, base, bytes(out)


class Objects:
    """Objects by their hash, from folders of loose objects and packs."""

    def __init__(self, folders: list[str], width: int = 20):
        self.width = width
        self.stores = [files.store_of(f) for f in folders]
        self.packs: list[_Pack] | None = None
        self.held: dict[tuple[int, int], tuple[int, bytes]] = {}

    def read(self, name: bytes) -> tuple[int, bytes]:
        """(kind, contents)."""
        digits = name.hex()
        for fs, folder in self.stores:
            try:
                with fs.open_input_stream(f"{folder}/{digits[:2]}/{digits[2:]}", compression=None) as stream:
                    head, _, body = zlib.decompress(stream.read()).partition(b"\0")
                return KINDS[head.split()[0]], body
            except FileNotFoundError:
                pass
        if self.packs is None:
            self.packs = [_Pack(fs, f.path, self.width) for fs, folder in self.stores for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{folder}/pack", allow_not_found=True)) if f.path.endswith(".idx")]
        for i, pack in enumerate(self.packs):
            at = pack.place(name)
            if at is not None:
                return self._packed(i, at)
        raise LookupError(f"no object {digits}")

    def _packed(self, i: int, at: int) -> tuple[int, bytes]:
        """The object at a place: its deltas are gathered down to a whole object, then applied."""
        chain: list[tuple[int, bytes]] = []
        while (i, at) not in self.held:
            kind, base, body = self.packs[i].entry(at)
            if kind == HASH_DELTA:
                chain.append((at, body))
                inside = self.packs[i].place(base)
                if inside is None:
                    found = self.read(base)
                    break
                at = inside
            elif kind == OFFSET_DELTA:
                chain.append((at, body))
                at = base
            else:
                found = (kind, body)
                break
        else:
            found = self.held[i, at]
        self._hold(i, at, found)
        for at, delta in reversed(chain):
            found = (found[0], apply_delta(found[1], delta))
            self._hold(i, at, found)
        return found

    def _hold(self, i: int, at: int, found: tuple[int, bytes]) -> None:
        if len(found[1]) <= files.MAX_REF_BYTES:
            if len(self.held) >= REMEMBERED:
                self.held.clear()
            self.held[i, at] = found

    def tree_of(self, name: bytes) -> bytes:
        """The tree of a commit, or of a tag of one."""
        while True:
            kind, body = self.read(name)
            if kind == TREE:
                return name
            word = {COMMIT: b"tree", TAG: b"object"}[kind]
            name = bytes.fromhex(re.match(word + rb" ([0-9a-f]+)\n", body)[1].decode())

    def entries(self, tree: bytes) -> Iterator[tuple[str, str, bytes]]:
        """(mode, name, hash) of a tree's entries."""
        _, raw = self.read(tree)
        at = 0
        while at < len(raw):
            end = raw.index(b"\0", at)
            mode, _, name = raw[at:end].partition(b" ")
            at = end + 1 + self.width
            yield mode.decode(), name.decode("utf-8", "replace"), raw[end + 1 : at]


def object_folders(spark: SparkSession, root: str) -> list[str]:
    """Where a repository keeps its objects: its own folder, that of a worktree's repository, and alternates."""
    folder = repository._git_folder(spark, root)
    shared = repository._text(spark, f"{folder}/commondir")
    out = [f"{folder}/{shared}/objects" if shared and not shared.startswith("/") else f"{shared or folder}/objects"]
    for at in out:
        for line in (repository._text(spark, f"{at}/info/alternates") or "").splitlines():
            other = line if line.startswith("/") else f"{at}/{line}"
            if line and not line.startswith("#") and other not in out:
                out.append(other)
    return out


def resolve(spark: SparkSession, root: str, ref: str) -> str | None:
    """The commit (or tag) that a name stands for: a hash, a branch, a remote's branch, a tag, or a full name."""
    if repository._SHA.fullmatch(ref):
        return ref
    short = re.sub("^refs/(heads|remotes)/", "", ref)
    return repository.commit_of(spark, root, short) or repository.ref_of(spark, root, ref if ref.startswith("refs/") else f"refs/tags/{ref}")


def list_ref(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """item_path, mode, object (hash) of all files of a ref."""
    sha = resolve(spark, root, ref)
    if sha is None:
        raise LookupError(f"unknown ref: {ref}")
    folders, width = object_folders(spark, root), len(sha) // 2
    objects = Objects(folders, width)
    rows: list[tuple[str, str, str]] = []
    trees = [("", objects.tree_of(bytes.fromhex(sha)))]

    def level(objects: Objects, prefix: str, tree: bytes) -> tuple[list[tuple[str, str, str]], list[tuple[str, bytes]]]:
        found, below = [], []
        for mode, name, of in objects.entries(tree):
            if mode == FOLDER_MODE:
                below.append((f"{prefix}{name}/", of))
            else:
                found.append((f"{prefix}{name}", mode, of.hex()))
        return found, below

    while trees and len(trees) < SPREAD:
        below: list[tuple[str, bytes]] = []
        for prefix, tree in trees:
            found, inside = level(objects, prefix, tree)
            rows += found
            below += inside
        trees = below
    near = spark.createDataFrame(rows, "item_path string, mode string, object string")
    if not trees:
        return near

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects = Objects(folders, width)
        for b in batches:
            left = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            while left:
                found, inside = level(objects, *left.pop())
                left += inside
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(3)], names=["item_path", "mode", "object"])

    far = spark.createDataFrame([(p, bytearray(t)) for p, t in trees], "prefix string, tree binary").repartition(min(len(trees), 4 * SPREAD))
    return near.unionByName(far.mapInArrow(walk, "item_path string, mode string, object string"))


def read_objects(listed: DataFrame, folders: list[str], width: int = 20) -> DataFrame:
    """``listed`` (item_path, mode, object) with size and content as text; a submodule has neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects = Objects(folders, width)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                raw = [None if mode == files.LINK_MODES[1] else objects.read(bytes.fromhex(of))[1] for mode, of in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                texts = [None if r is None or len(r) > files.MAX_FILE_BYTES else r.decode("utf-8", "replace") for r in raw]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r and len(r) or 0 for r in raw], pa.int64()), pa.array(texts, pa.string())], names=["item_path", "mode", "object", "size", "content"])

    held = listed.persist()
    tasks = max(1, -(-held.count() // SLICE_FILES))
    # Objects that stand together in a pack are often made from one another, so a folder's files go to one task.
    return held.repartitionByRange(tasks, "item_path").mapInArrow(run, "item_path string, mode string, object string, size long, content string")


def read_ref(spark: SparkSession, root: str, ref: str, rules: list[files.Rule] | None = None) -> DataFrame:
    """item_path, content, hash, language of a ref's files that are to be indexed; no others are read."""
    kept = files.scan_ref(list_ref(spark, root, ref).withColumn("size", F.lit(0)), rules).select("item_path", "mode", "object")
    sha = resolve(spark, root, ref)
    rows = files.scan_ref(read_objects(kept, object_folders(spark, root), len(sha) // 2), rules)
    return rows.select("item_path", "content", T.content_hash(F.col("content")).alias("hash"), "language")
