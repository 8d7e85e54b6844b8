"""A deterministic hashing embedder, the batch planner and input caps of an embedding stage."""

from __future__ import annotations

import hashlib
import re
import time
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

#: Padded token slots of one batch; characters per token of an input's cap, and the cap without a limit.
SLOTS, CHARS_PER_TOKEN, DEFAULT_CAP = 4096, 4, 32_000
#: Lists of texts that may wait for an unfilled batch.
WAITING = 8
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


def char_cap(max_input_tokens: int | None) -> int:
    return max_input_tokens * CHARS_PER_TOKEN if max_input_tokens else DEFAULT_CAP


def plan_batches(lengths: list[int], max_tokens: int = 512, slots: int = SLOTS) -> list[list[int]]:
    """Indices of texts in batches, shortest first, whose rows times padded length stay within ``slots``; at least one row each."""
    padded = [min(max_tokens, n + 2) for n in lengths]
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: padded[i]):
        if out and (len(out[-1]) + 1) * padded[i] <= slots:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def cap_text(text: str, cap: int) -> str:
    """The text up to ``cap`` characters that are not white space; never longer than eight times the cap."""
    seen = 0
    for i, c in enumerate(text[: cap * 8]):
        seen += not c.isspace()
        if seen > cap:
            return text[:i]
    return text[: cap * 8]


def hash_vector(text: str, dims: int) -> np.ndarray:
    """Signed hashed words, of length one; zero for a text without words."""
    v = np.zeros(dims, dtype=np.float32)
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


class TooLarge(ValueError):
    """A batch that the model refuses for its size."""


class RateLimited(RuntimeError):
    """The model asks to wait."""


def probe_size(last_successful: int | None, least_failed: int | None, ceiling: int) -> int:
    """The batch size to begin with: the middle of what worked and what did not, or what worked once the two have met."""
    if last_successful is None or least_failed is None:
        return ceiling
    return last_successful if least_failed - last_successful <= 1 else (last_successful + least_failed) // 2


class Sizes:
    """The largest batch that went through in one piece and the smallest that was refused."""

    def __init__(self) -> None:
        self.good, self.refused = 0, None

    def note(self, n: int, good: bool) -> None:
        if good:
            self.good = max(self.good, n)
        else:
            self.refused = n if self.refused is None else min(self.refused, n)


def adaptive(call: Callable[[list[str]], list], texts: list[str], too_large: type[Exception] = ValueError, sizes: Sizes | None = None) -> list:
    """``call(texts)``, halving a batch that is refused as too large; a single text that is refused raises."""
    try:
        out = call(texts)
    except too_large:
        if sizes is not None:
            sizes.note(len(texts), False)
        if len(texts) == 1:
            raise
        half = len(texts) // 2
        return adaptive(call, texts[:half], too_large, sizes) + adaptive(call, texts[half:], too_large, sizes)
    if sizes is not None:
        sizes.note(len(texts), True)
    return out


def patient(call: Callable[[], list], tries: int = 5, first_wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """``call()``, tried again after a wait that doubles while the model is rate-limited."""
    for k in range(tries):
        try:
            return call()
        except RateLimited:
            if k == tries - 1:
                raise
            sleep(first_wait * 2**k)
    raise AssertionError


def encode_all(texts: list[str], call: Callable[[list[str]], list], dims: int, size: int | None = None, max_tokens: int = 512, sizes: Sizes | None = None) -> list:
    """Vectors of all texts in their order: planned batches of at most ``size``, halved where refused, patient where limited; a vector of another size raises."""
    out: list = [None] * len(texts)
    for batch in plan_batches([len(t) // CHARS_PER_TOKEN for t in texts], max_tokens):
        for at in range(0, len(batch), size or len(batch)):
            part = batch[at : at + (size or len(batch))]
            vectors = adaptive(lambda some: patient(lambda: call(some)), [texts[i] for i in part], TooLarge, sizes)
            for i, v in zip(part, vectors, strict=True):
                if len(v) != dims:
                    raise ValueError(f"the model gives vectors of {len(v)} components, not {dims}")
                out[i] = v
    return out


def encode_stream(lists: Iterator[list[str]], call: Callable[[list[str]], list], dims: int, size: int | None = None, max_tokens: int = 512, sizes: Sizes | None = None) -> Iterator[list]:
    """The vectors of each list, in order; a batch that a list leaves unfilled is filled from the next ones."""
    waiting: deque[list] = deque()
    held: list[tuple[list, int, str]] = []

    def encode(some: list[tuple[list, int, str]]) -> None:
        for (out, i, _), v in zip(some, encode_all([t for _, _, t in some], call, dims, size, max_tokens, sizes), strict=True):
            out[i] = v

    for texts in lists:
        waiting.append([None] * len(texts))
        held += [(waiting[-1], i, t) for i, t in enumerate(texts)]
        plan = plan_batches([len(t) // CHARS_PER_TOKEN for _, _, t in held], max_tokens)
        filled = plan if len(waiting) > WAITING else plan[:-1]
        encode([held[i] for batch in filled for i in batch])
        held = [held[i] for batch in plan[len(filled) :] for i in batch]
        blocked = {id(out) for out, _, _ in held}
        while waiting and id(waiting[0]) not in blocked:
            yield waiting.popleft()
    encode(held)
    yield from waiting


def embed(rows: DataFrame, text: str, dims: int, prefix: str = PASSAGE_PREFIX, encode: Callable[[str, int], np.ndarray] = hash_vector, max_input_tokens: int | None = None, size: int | None = None, report: bool = False) -> DataFrame:
    """Adds vector array<float>; ``encode`` runs on the executors in planned batches.

    Rows are sorted by length within their partition, and batches are filled
    across Arrow batches, so texts of like length are padded together.
    ``encode(text, dims)`` gives one vector; an encoder with a true attribute
    ``batched`` gets a list of texts.  ``report`` adds __good and __refused, the
    batch sizes met by the row's worker.
    """
    cap = char_cap(max_input_tokens)
    more = [StructField("vector", ArrayType(FloatType()))] + ([StructField("__good", LongType()), StructField("__refused", LongType())] if report else [])
    schema = StructType([*rows.schema.fields, *more])

    def call(texts: list[str]) -> list:
        return encode(texts, dims) if getattr(encode, "batched", False) else [encode(t, dims) for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, read = Sizes(), deque()

        def texts() -> Iterator[list[str]]:
            for b in batches:
                read.append(b)
                yield [cap_text(prefix + (t or ""), cap) for t in b.column(b.schema.get_field_index(text)).to_pylist()]

        for vectors in encode_stream(texts(), call, dims, size, max_input_tokens or 512, sizes):
            b = read.popleft()
            columns = [*b.columns, pa.array([np.asarray(v, dtype=np.float32).tolist() for v in vectors], pa.list_(pa.float32()))]
            if report:
                columns += [pa.array([sizes.good] * b.num_rows, pa.int64()), pa.array([sizes.refused] * b.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *(f.name for f in more)])

    return rows.sortWithinPartitions(F.length(text)).mapInArrow(run, schema)


def needs_new_vectors(old: dict, new: dict) -> bool:
    """Whether a change of settings asks for a new index: model, dimension or provider."""
    return any(old.get(k) != new.get(k) for k in ("model", "dims", "provider"))


def dimension_ok(rows: DataFrame, dims: int) -> DataFrame:
    """One row: rows, and how many vectors have another size."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.size("vector") != dims, 1)).alias("n_wrong"))
