"""A vector index of cells that prunes: residual product-quantised codes, of which a query reads the nearest cells' only.

The model is fitted on a bounded sample: about twice the root of the rows as cell
centres, and for the residuals, in groups of ``GROUP`` components, 256 values each.
Every row is coded: its nearest centre's cell and a byte for each group.  Codes are
kept sorted by cell, so a filter on cells skips the row groups of all others.  A
query probes about twice the root of the cells, scores their decoded rows by a
product with all queries of the cell at once, first its nearest cell's for a bar,
and scores the best ``REFINE`` times k exactly.
A cell of many rows is dealt in blocks, so near-copies of one vector are many tasks.

``search_whole`` gives what a search without an index gives, ties by id too: the
k-th score found so far is a bar, and of every cell whose widest angle from its
centre lets a row reach it the vectors are read and scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.vectors import cosine

from .retrieval import DATA_BLOCK, SCORES, _unit, _unit_vectors, best_rows, nearest, top_k

#: Rows of the sample, cells at most, components of a group, values of a group, rounds of fitting.
SAMPLE, MOST_CELLS, GROUP, VALUES, ROUNDS = 50_000, 2048, 4, 256, 8
#: Exactly scored candidates are k times this.
REFINE = 8
#: Bounds and scores are rounded apart: a cell whose bound is this near the bar is read too.
SLACK = 1e-6

MODEL = "kind string, no int, part int, value array<float>"


@dataclass
class Cells:
    """Cell centres (cells, dims) and the values of each group of residual components (groups, values, GROUP)."""

    centres: np.ndarray
    values: np.ndarray

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    @property
    def probes(self) -> int:
        return min(len(self.centres), int(np.ceil(1.5 * np.sqrt(len(self.centres)))))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n cells whose centres are nearest each vector, nearest first."""
        near = x @ self.centres.T
        near -= (self.centres**2).sum(axis=1) / 2
        return np.argmax(near, axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]

    def _groups(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.values.shape[0] * GROUP), dtype=np.float32)
        wide[:, : self.dims] = x
        return wide.reshape(len(x), -1, GROUP)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, a byte for each group) of vectors of length one."""
        cell = self.nearest(x, 1)[:, 0]
        rest = self._groups(x - self.centres[cell])
        code = np.empty(rest.shape[:2], dtype=np.uint8)
        for g, book in enumerate(self.values):
            near = rest[:, g] @ book.T
            near -= (book**2).sum(axis=1) / 2
            code[:, g] = np.argmax(near, axis=1)
        return cell, code

    def decode(self, cell: int, code: np.ndarray) -> np.ndarray:
        """The vectors that the codes of a cell stand for."""
        rest = np.stack([book[code[:, g]] for g, book in enumerate(self.values)], axis=1)
        return self.centres[cell] + rest.reshape(len(code), -1)[:, : self.dims]


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres by Lloyd's rounds; a centre that nothing is near takes a random row."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(ROUNDS):
        near = np.concatenate([np.argmax(2 * part @ centres.T - (centres**2).sum(axis=1), axis=1) for part in np.array_split(x, max(1, len(x) // 8192))])
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, weights=column, minlength=len(centres)) for column in x.T], axis=1)
        full = counts > 0
        centres[full] = (sums[full] / counts[full, None]).astype(np.float32)
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def fit(vectors: DataFrame, dims: int, cells: int | None = None, seed: int = 7) -> Cells:
    """A model from at most ``SAMPLE`` rows (chosen by a hash of the id) of vectors (chunk_id, vector)."""
    n = vectors.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    rows = vectors.filter(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(SAMPLE).toPandas()
    x = _unit_vectors(rows["vector"], dims).astype(np.float32)
    x = x[np.lexsort(x.T[::-1])]  # the order of a sample's rows says nothing
    rng = np.random.default_rng(seed)
    groups = -(-dims // GROUP)
    if not len(x):
        return Cells(np.zeros((1, dims), np.float32), np.zeros((groups, 1, GROUP), np.float32))
    centres = _means(x, cells or min(MOST_CELLS, max(1, round(2 * n**0.5))), rng)
    model = Cells(centres, np.zeros((groups, 1, GROUP), np.float32))
    rest = model._groups(x - centres[model.nearest(x, 1)[:, 0]])
    books = [_means(rest[:, g], VALUES, rng) for g in range(groups)]
    return Cells(centres, np.stack(books))


def model_rows(spark: SparkSession, model: Cells) -> DataFrame:
    """The model as rows, to be kept beside the codes: at most MOST_CELLS + groups * VALUES."""
    rows = [("centre", i, 0, c.tolist()) for i, c in enumerate(model.centres)]
    rows += [("value", g, v, x.tolist()) for g, book in enumerate(model.values) for v, x in enumerate(book)]
    return spark.createDataFrame(rows, MODEL)


def model_of(rows: DataFrame) -> Cells:
    found = rows.orderBy("kind", "no", "part").collect()
    centres = np.array([r["value"] for r in found if r["kind"] == "centre"], dtype=np.float32)
    values = [r for r in found if r["kind"] == "value"]
    groups = 1 + max(r["no"] for r in values)
    return Cells(centres, np.array([r["value"] for r in values], dtype=np.float32).reshape(groups, -1, GROUP))


def codes(vectors: DataFrame, model: Cells) -> DataFrame:
    """chunk_id, cell, code of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                cell, code = model.encode(_unit_vectors(part["vector"], model.dims).astype(np.float32))
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "cell": cell.astype(np.int32), "code": [r.tobytes() for r in code]})

    id_type = vectors.schema["chunk_id"].dataType.simpleString()
    return vectors.select("chunk_id", "vector").mapInPandas(run, f"chunk_id {id_type}, cell int, code binary")


def laid_out(coded: DataFrame) -> DataFrame:
    """Codes in the order in which they are kept."""
    return coded.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id")


def probed(queries: DataFrame, model: Cells, probes: int | None = None) -> DataFrame:
    """query_id, vector, cell, place: the cells that each query reads, from 0 for the nearest."""
    n = probes or model.probes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = model.nearest(_unit_vectors(b["vector"], model.dims).astype(np.float32), n)
            yield pd.DataFrame({"query_id": b["query_id"].repeat(near.shape[1]), "vector": b["vector"].repeat(near.shape[1]), "cell": near.ravel().astype(np.int32), "place": np.tile(np.arange(near.shape[1], dtype=np.int32), len(b))})

    query_type = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "vector").mapInPandas(run, f"query_id {query_type}, vector array<float>, cell int, place int")


def candidates(coded: DataFrame, asked: DataFrame, model: Cells, most: int) -> DataFrame:
    """query_id, chunk_id, score: at least the ``most`` best rows of each query by the codes of the cells that it reads (see ``probed``)."""
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS
    read = coded.filter(F.col("cell").isin(cells))
    blocks = read.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / DATA_BLOCK).cast("int").alias("blocks"))
    rows = read.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
    each = asked.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    id_type, query_type = coded.schema["chunk_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def best(key: tuple, d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows, columns, scores = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.float32))
        if not d.empty and not q.empty:
            x = model.decode(key[0], np.frombuffer(b"".join(d["code"]), dtype=np.uint8).reshape(len(d), -1))
            step = max(1, SCORES // len(d))
            for at in range(0, len(q), step):
                part = q.iloc[at : at + step]
                score = _unit_vectors(part["vector"], model.dims).astype(np.float32) @ x.T
                bar = part["bar"].to_numpy(dtype=np.float32) - np.float32(SLACK)
                if len(d) > most:
                    # The most-th of the maxima of runs of rows is no more than the most-th score, and much cheaper.
                    runs = min(len(d), 4 * most)
                    peaks = np.maximum.reduceat(score, np.arange(runs) * len(d) // runs, axis=1)
                    bar = np.maximum(bar, np.partition(peaks, -most, axis=1)[:, -most])
                row, column = np.divmod(np.flatnonzero(score >= bar[:, None]), len(d))
                value = score[row, column]
                keep = best_rows(row, d["chunk_id"].to_numpy()[column], value, most)
                rows.append(row[keep] + at)
                columns.append(column[keep])
                scores.append(value[keep])
        row, column = np.concatenate(rows), np.concatenate(columns)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[row], "chunk_id": d["chunk_id"].to_numpy()[column], "score": np.concatenate(scores).astype(np.float64)})

    def scored(each: DataFrame) -> DataFrame:
        return rows.select("cell", "block", "chunk_id", "code").groupBy("cell", "block").cogroup(each.select("cell", "block", "query_id", "vector", "bar").groupBy("cell", "block")).applyInPandas(best, f"query_id {query_type}, chunk_id {id_type}, score double")

    open_ = F.lit(-np.inf).cast("float")
    first = top_k(scored(each.filter("place = 0").withColumn("bar", open_)), most, ["query_id"])
    bars = first.filter(F.col("rank") == most).select("query_id", F.col("score").cast("float").alias("bar"))
    return scored(each.join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", open_)))


def search(vectors: DataFrame, coded: DataFrame, model: Cells, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the k most similar vectors of the probed cells, scored exactly."""
    near = top_k(candidates(coded, probed(queries, model, probes), model, k * REFINE), k * REFINE, ["query_id"]).select("query_id", "chunk_id")
    exact = near.join(vectors.select("chunk_id", F.col("vector").alias("__v")), "chunk_id").join(queries.select("query_id", F.col("vector").alias("__q")), "query_id")
    return top_k(exact.select("query_id", "chunk_id", cosine(F.col("__q"), F.col("__v")).alias("score")), k, ["query_id"])


def search_whole(vectors: DataFrame, coded: DataFrame, model: Cells, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the k most similar of all vectors, the rows of ``retrieval.search``; cells that can hold none of them are not scored."""
    bars = search(vectors, coded, model, queries, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    axes, dims = _unit(model.centres.astype(np.float64)), model.dims
    id_type, query_type = vectors.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                x = _unit_vectors(part["value"], dims)
                cell = model.nearest(x.astype(np.float32), 1)[:, 0]
                yield part.assign(cell=cell.astype(np.int32), near=(x * axes[cell]).sum(axis=1))

    placed = vectors.select("chunk_id", F.col("vector").alias("value")).mapInPandas(place, f"chunk_id {id_type}, value array<float>, cell int, near double")
    wide = placed.groupBy("cell").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("n")).collect()  # at most MOST_CELLS
    cells = np.array([r["cell"] for r in wide], dtype=np.int32)
    angle = np.arccos(np.clip([r["near"] for r in wide], -1, 1))
    blocks = vectors.sparkSession.createDataFrame([(r["cell"], -(-r["n"] // DATA_BLOCK)) for r in wide], "cell int, blocks int")

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                apart = np.arccos(np.clip(_unit_vectors(part["vector"], dims) @ axes[cells].T, -1, 1))
                row, column = np.nonzero(np.cos(np.maximum(apart - angle, 0)) + SLACK >= part["bar"].to_numpy()[:, None])
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "vector": part["vector"].to_numpy()[row], "cell": cells[column]})

    asked = queries.select("query_id", "vector").join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0)))
    asked = asked.mapInPandas(reach, f"query_id {query_type}, vector array<float>, cell int").join(F.broadcast(blocks), "cell")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))

    def best(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if d.empty or q.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "chunk_id": d["chunk_id"][:0], "score": np.zeros(0)})
        return nearest(d, q, k, dims)

    both = rows.select("cell", "block", "chunk_id", "value").groupBy("cell", "block").cogroup(asked.select("cell", "block", "query_id", "vector").groupBy("cell", "block"))
    return top_k(both.applyInPandas(best, f"query_id {query_type}, chunk_id {id_type}, score double"), k, ["query_id"])


def share_read(coded: DataFrame, queries: DataFrame, model: Cells, probes: int | None = None) -> DataFrame:
    """One row: the mean share of all codes that a query reads."""
    sizes = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    read = probed(queries, model, probes).join(sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return read.crossJoin(F.broadcast(total)).agg(F.round(F.avg(F.col("n") / F.col("total")), 6).alias("share_read"))
