"""What the text operators share: reading tables, shared storage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words here.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, UPPER.lower())


def bind(value, use):
    """use(value) with ``value`` evaluated once per row.

    A lambda over an array column names the array by its expression; bound to a
    variable of an outer lambda instead, it isn't computed again per element.
    """
    return F.transform(F.array(value), use)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one in local mode if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="roomlens-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage.

    The files outlive any executor, and go when the driver's JVM ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


def whole_runs(batches: Iterator[pa.RecordBatch], least: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (the last may have fewer) that hold whole runs of equal keys (the first column) of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            whole = pa.Table.from_batches(held).combine_chunks()
            key = whole.column(0).to_numpy()
            cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])  # the last run may go on
            if cut:
                yield whole.slice(0, cut).combine_chunks()
            held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component its smallest node.

    Only nodes of ``edges`` come back. Alternating large-star and small-star rounds:
    each is two min-aggregations, with partial sums before the shuffle, and two
    equi-joins whose hot keys Spark can split; a hub is never gathered in one task.
    Self-loops and repeated edges do no harm; edges with a null end are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    e = spool(e, "edges")
    for _ in range(most_rounds):
        if _is_star(e):
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = spool(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_star(e: DataFrame) -> bool:
    """Whether each node has one parent and no parent has a parent."""
    twice = e.groupBy("u").count().where("count > 1")
    if not twice.isEmpty():
        return False
    return e.select(F.col("v").alias("u")).distinct().join(e, "u", "left_semi").isEmpty()
