"""Line-window chunks as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

#: Lines of a window, and lines that neighbouring windows share.
SIZE, OVERLAP = 60, 10


def lines_of(content: Column) -> Column:
    """Lines with their terminators; an empty text has none."""
    return F.filter(F.split(content, "(?dm)^", -1), lambda p: p != "")


def capped(lines: Column, max_chars: int) -> Column:
    """Leading whole lines that fit in ``max_chars``, at least one; a first line that alone exceeds it is cut."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("int").alias("chars"), F.lit(False).alias("full"))

    def step(acc: Column, line: Column) -> Column:
        fits = ~acc["full"] & ((acc["n"] == 0) | (acc["chars"] + F.length(line) <= max_chars))
        return F.struct(F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(fits, acc["chars"] + F.length(line)).otherwise(acc["chars"]).alias("chars"), (acc["full"] | ~fits).alias("full"))

    used = F.aggregate(lines, start, step)["n"]
    return F.struct(F.substring(F.array_join(F.slice(lines, 1, used), ""), 1, max_chars).alias("content"), used.alias("used"))


def window_chunks(files: DataFrame, content: str = "content", size: int = SIZE, overlap: int = OVERLAP, max_chars: int | None = None) -> DataFrame:
    """One row per window of lines: adds start_line, end_line (1-based, inclusive) and chunk, dropping ``content``.

    Windows begin every size - overlap lines up to the last line, also where the
    window before reached the end; a window that is blank after trimming goes.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    # Windows are made inside the generator, so that no expression on lines is worked out twice.
    rows = files.withColumn("__lines", lines_of(T.normalize_content(F.col(content))))

    def window(at: Column) -> Column:
        part = F.slice("__lines", at + 1, size)
        body = F.struct(F.array_join(part, "").alias("content"), F.size(part).alias("used")) if max_chars is None else capped(part, max_chars)
        return F.struct((at + 1).alias("start_line"), (at + body["used"]).alias("end_line"), T.trim_blank(body["content"]).alias("chunk"))

    starts = F.when(F.size("__lines") > 0, F.sequence(F.lit(0), F.size("__lines") - 1, F.lit(step)))
    made = F.filter(F.transform(starts, window), lambda w: w["chunk"] != "")
    others = [c for c in files.columns if c != content]
    return rows.select(*others, F.explode(made).alias("__w")).select(*others, "__w.start_line", "__w.end_line", "__w.chunk")


def stamp(chunks: DataFrame, kind: str = "code") -> DataFrame:
    """Adds chunk_id from project_id, source_id, item_path, item_url and chunk."""
    return chunks.withColumn("chunk_id", T.chunk_id(F.col("project_id"), F.col("source_id"), F.col("item_path"), F.col("item_url"), F.lit(kind), F.col("chunk")))


def first_seen(chunks: DataFrame, order: list[str], key: str = "chunk_id") -> DataFrame:
    """Of rows that share a key, the first by ``order``; the other columns are that row's."""
    others = [c for c in chunks.columns if c != key]
    first = chunks.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return first.select(key, "__row.*").select(*chunks.columns)
