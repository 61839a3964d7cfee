"""What the operators share: tables, the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset (local runs, tests), a temporary one is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="tessera-")
        shared_dir.own = at
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors and keeps its size known to the planner."""
    at = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written(); only for those that nothing reads any more, a lost executor's work included."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Gives memory that this process has freed back to the machine."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Rows of an Arrow batch between Spark and Python at most: texts are long, so Spark's own 10,000 would take much memory on both sides.
BATCH_ROWS = 2000


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), with batches of BATCH_ROWS rows at most (a session setting) and memory given back after each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


_resident: dict[object, object] = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """What this Python worker keeps between tasks: one object at a time, so that the next operator's takes the last one's place."""
    if key not in _resident:
        if _resident:
            _resident.clear()
            give_back()
        _resident[key] = make()
    return _resident[key]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch, of about `most` bytes of text each and at least a row: bounds what an operator holds at once."""
    at, held = 0, 0
    for i, n in enumerate(batch.column(text)):
        n = len(n.as_buffer()) if n.is_valid else 0
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (as many as its size) for each start, in turn."""
    ends = np.cumsum(sizes, dtype=np.int32)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) for each node of `edges`: the smallest node that it reaches. Alternates large-star and small-star steps
    (Kiveris et al. 2014): each node's list stays distributed, and the number of edges never grows. The steps end when a
    round changes nothing; each round is written to the shared folder.
    Null ends and loops are ignored; no edges: no rows."""
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = written(e, "edges")
    state = None
    for _ in range(most):
        # Large star: every larger neighbour of u is linked to u's smallest neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # Small star: every smaller neighbour of u, and u, are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before, e = e, written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        state = now
    raise RuntimeError("the components did not settle")
