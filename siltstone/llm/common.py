"""Small helpers shared by the training-text operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch on its way to a Python worker, and rows that a worker handles at once.
ARROW_BYTES, SLICE = 2 << 20, 128

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Batches = Iterator[pa.RecordBatch]


def in_slices(df: DataFrame, run: Callable[[Batches], Batches], schema: str | StructType, rows: int = SLICE) -> DataFrame:
    """``df.mapInArrow(run)`` over slices of at most ``rows`` rows.

    The rows are bounded inside the worker, so they hold whenever the plan runs.
    The bytes of a batch are a session setting that all operators give one value.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def sliced(batches: Batches) -> Batches:
        return run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))

    return df.mapInArrow(sliced, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where that is unset, one of our own."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _own_dir


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Lineage ends there, a lost executor costs nothing that was written, and the
    planner knows the true size: it broadcasts a side only under
    spark.sql.autoBroadcastJoinThreshold and shuffles otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def discard(spark: SparkSession, *done: DataFrame) -> None:
    """Delete materialised tables that no later plan reads, and let go of the shuffle files of finished jobs."""
    jvm = spark.sparkContext._jvm
    for df in done:
        path = jvm.org.apache.hadoop.fs.Path(df._siltstone_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def crc_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def choose_ids(ids: DataFrame, per_class: int, most: int) -> DataFrame | None:
    """At most ``per_class`` ids for each label of ``ids`` (doc_id, __label), and at most ``most`` in all, shared alike.

    The choice is by a hash of the id, so it does not depend on partitions.  Of
    a class of n ids, those of a hash range that holds about twice as many as
    are wanted are ranked, so no task ever gets a whole class.
    """
    order = F.xxhash64("doc_id", F.lit(17))
    counts = ids.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "__label").limit(most).collect()
    if not counts:
        return None
    per_class = max(1, min(per_class, most // len(counts)))
    shares = ids.sparkSession.createDataFrame([(r["__label"], min(1.0, (2 * per_class + 200) / r["n"])) for r in counts], "__label string, __share double")
    near = ids.join(F.broadcast(shares), "__label").filter(F.pmod(order, F.lit(1 << 30)) < F.col("__share") * (1 << 30)).select("doc_id", "__label").distinct()
    rank = F.row_number().over(Window.partitionBy("__label").orderBy(order, "doc_id"))
    return near.withColumn("__rank", rank).filter(F.col("__rank") <= per_class).drop("__rank")


def labelled_sample(rows: DataFrame, label: str, per_class: int, most: int, max_chars: int) -> list[tuple[str, str]]:
    """(text, label) of a bounded choice of whole texts of at most ``max_chars`` characters; see ``choose_ids``."""
    usable = rows.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars)).withColumnRenamed(label, "__label")
    chosen = choose_ids(usable.select("doc_id", "__label"), per_class, most)
    if chosen is None:
        return []
    found = usable.join(F.broadcast(chosen), ["doc_id", "__label"], "left_semi")
    return sorted({(r["text"], r["__label"]) for r in found.select("text", "__label").collect()})


def commonest(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """At most ``most`` rows of ``counts`` with the greatest ``n``; counts are read more than once, so they should be materialised.

    What is near in ``n`` stands in one class; the classes, at most a thousand,
    are added up from the greatest, so neither a sort of all rows is made nor do
    the partitions' greatest rows meet on the driver.  Of the class that does not
    fit whole a share is taken by a hash of the row.
    """
    level = F.floor(F.log2(F.col(n)) * 16)
    total, least, share, low = 0, None, 0.0, 0
    for r in counts.groupBy(level.alias("k")).agg(F.count(F.lit(1)).alias("c"), F.min(n).alias("low")).orderBy(F.desc("k")).collect():
        if total + r["c"] > most:
            share, low = 0.95 * (most - total) / r["c"], r["low"]
            break
        total, least = total + r["c"], r["low"]
    whole = F.lit(False) if least is None else F.col(n) >= least
    part = (F.col(n) >= low) & (F.pmod(F.xxhash64(*counts.columns), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return counts.filter(whole | part if share else whole).limit(most)
