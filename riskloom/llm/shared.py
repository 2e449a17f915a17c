"""Helpers that several corpus operators use: shared scratch tables, Arrow batches, components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that a Python worker gets at a time while a scratch table is written. Spark's own 64 MB (or 10,000 rows)
#: stand in the JVM and in each worker, and idle workers keep their share of an executor's memory.
BATCH = 2 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables: the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs in one process (tests, a laptop) is a temporary folder
    made and used; on a cluster without it an error is raised.
    """
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder; cuts its lineage. Python workers get at most ``BATCH`` bytes (or a row) at a time."""
    spark, most = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path = f"{scratch_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(most))
    with settings(spark, {most: str(BATCH)} if now > BATCH else {}):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables from :func:`saved` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Holds session settings while a table is made, then puts the former values back."""
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in binary.to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts hold ``most_bytes`` together (a longer text comes alone)."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            total = np.cumsum(sizes[start:])
            stop = start + max(1, int(np.searchsorted(total, most_bytes, side="right")))
            rows = batch.slice(start, min(stop, batch.num_rows) - start)
            yield rows, raw_texts(rows.column(place))  # the texts of one slice at a time
            start = stop


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One uint8 array of all texts, and where each begins (with the end as a last entry)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), starts


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Connected components of undirected links between longs: one row ``node, root`` per linked node.

    ``root`` is the smallest node of the component. Each round points every node at its smallest
    neighbour, follows two pointers, and contracts the links to what still joins different roots, so
    that the links shrink by a constant factor a round; the loop ends when none is left. All of it
    stays in tables: the driver sees a count a round. Hot nodes are pre-aggregated (min) and their
    joins are plain sort-merge joins, which adaptive execution can split. Links with a null end or
    equal ends are ignored; repeated links do no harm.
    """
    links = links.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    links = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    known = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.least("u", F.min("v")).alias("p"))
        parent = saved(parent)
        for _ in range(2):
            jump = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(jump, "p").select("u", F.col("pp").alias("p"))
        parent = saved(parent)
        if known is None:
            known = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("u").alias("root"), F.col("p").alias("next"))
            known = known.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        known = saved(known)
        to_u = parent.select("u", F.col("p").alias("a"))
        to_v = parent.select(F.col("u").alias("v"), F.col("p").alias("b"))
        links = links.join(to_u, "u").join(to_v, "v").where("a <> b")
        links = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    return known if known is not None else links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def release(spark: SparkSession) -> None:
    """Lets the driver drop shuffle files of finished jobs: Spark does so when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
