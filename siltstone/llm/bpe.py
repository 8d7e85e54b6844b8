"""Byte-level BPE encoding and decoding through a sentencepiece model that is
serialised straight from the vocabulary.

Every vocabulary entry becomes one piece: its bytes are mapped to printable
characters, its score is the negative rank, its id is the rank.  With identity
normalisation, no dummy prefix and no white-space escaping, sentencepiece's
merge loop (highest score first, leftmost on ties) is then the rank-order merge
loop of a byte-level BPE, applied to each pre-token by itself.

Defined results: a null text counts as empty and gives no tokens; repeated rows
each give a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import in_slices

#: Distinct pre-tokens that a Python worker remembers before it starts afresh.
CACHE_ENTRIES = 200_000

#: Unicode White_Space, as `\s` of the vocabulary's own library has it.
_SPACE = r"\p{White_Space}"

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of lines 'base64 rank'."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


@lru_cache(maxsize=1)
def alphabet() -> tuple[str, ...]:
    """A printable character for each byte: its Latin-1 character where that is visible, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return tuple(out)


def to_pieces(raw: bytes) -> str:
    table = alphabet()
    return "".join([table[b] for b in raw])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a sentencepiece BPE model; ids are ranks, the unknown piece follows the last rank.

    Ranks without a token become unused pieces, so later ids keep their place.
    """
    by_rank = {rank: token for token, rank in ranks.items()}
    size = max(by_rank, default=-1) + 1
    normal, unknown, unused = 1, 2, 5
    out = bytearray()

    def piece(text: str, score: float, kind: int) -> None:
        out.extend(_block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)))

    for rank in range(size):
        if rank in by_rank:
            piece(to_pieces(by_rank[rank]), -float(rank), normal)
        else:
            piece(f"<unused {rank}>", -float(rank), unused)
    piece("<unk>", 0.0, unknown)
    bpe = 2
    absent = (1 << 64) - 1  # -1
    out += _block(2, _number(3, bpe) + _number(4, size + 1) + _number(40, size) + b"".join(_number(f, absent) for f in (41, 42, 43)))
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encodes pre-tokens with the serialised model and decodes ids by the inverse byte mapping."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\s", _SPACE).replace(r"\S", rf"\P{{White_Space}}")).findall
        back = {c: b for b, c in enumerate(alphabet())}
        n = self.sp.get_piece_size() - 1
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b"" if p.startswith("<unused ") else bytes([back[c] for c in p]) for p in self.pieces]
        self.whole = {p: i for i, p in enumerate(self.pieces)}
        self.known: dict[str, tuple[list[int], bytes]] = {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def learn(self, tokens: set[str]) -> None:
        """Encode pre-tokens that the cache lacks; one that is an entry itself keeps that entry's id."""
        new = [t for t in tokens if t not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
            new = list(tokens)
        mapped = [to_pieces(t.encode()) for t in new]
        for token, text, ids in zip(new, mapped, self.sp.encode(mapped, out_type=int, num_threads=1), strict=True):
            if text in self.whole:
                ids = [self.whole[text]]
            self.known[token] = (len(ids), ",".join(map(str, ids)), self.decode(ids))

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        self.learn(set(tokens))
        return [int(i) for t in tokens for i in self.known[t][1].split(",")]

    def digests(self, text: str) -> tuple[int, str, str]:
        tokens = self.split(text)
        self.learn(set(tokens))
        known = [self.known[t] for t in tokens]
        ids = ",".join([k[1] for k in known])
        return sum([k[0] for k in known]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([k[2] for k in known])).hexdigest()


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(model: bytes, pattern: str) -> Codec:
    key = (hash(model), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, pattern)
    return _codecs[key]


def _ship(docs: DataFrame, path: str):
    """The model for the executors: its size is the vocabulary's, whatever the corpus."""
    return docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(path)))


def _mapped(frame: DataFrame, path: str, pattern: str, schema: str, rows) -> DataFrame:
    """``rows(codec, values)`` gives the columns after doc_id for one batch of the frame's second column."""
    model = _ship(frame, path)
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for b in batches:
            columns = rows(codec, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(fields)[1:], strict=True))], schema=fields)

    return in_slices(frame, run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: the token ids of each whole text."""
    return _mapped(_texts(docs), path, pattern, "doc_id long, ids array<int>", lambda codec, texts: [[codec.encode(t) for t in texts]])


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text: the texts of ``encode``'s ids."""
    return _mapped(tokens.select("doc_id", "ids"), path, pattern, "doc_id long, text string", lambda codec, ids: [[codec.decode(i).decode() for i in ids]])


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode every whole text, decode the ids, digest both."""

    def rows(codec: Codec, texts: list[str]) -> list:
        found = [codec.digests(t) for t in texts]
        return [[f[i] for f in found] for i in range(3)]

    return _mapped(_texts(docs), path, pattern, SCHEMA, rows)
