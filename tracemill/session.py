"""Session settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tracemill", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller passes its own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; choose one only where none is set (tests, local runs)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tracemill-checkpoints")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once to the shared folder and read back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable by Python workers wherever the session runs: its sources, a few hundred kB, go once
    per application through the driver's file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="tracemill-"), "tracemill.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that attach() joins by broadcast.
HOT_KEYS = 1_000


def attach(x: DataFrame, values: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """x with the columns of `values` (one row per key, keys not null), which every key of x has.

    The HOT_KEYS most frequent keys, by `counts` (keys and count), are joined by broadcast of so many rows; what is left has
    no key with more than a thousandth of the rows and is joined by shuffle. x and counts are read more than once.
    """
    hot = counts.orderBy(F.desc("count"), *keys).limit(HOT_KEYS).select(*keys)
    hot = cut_lineage(hot)
    few = F.broadcast(values.join(F.broadcast(hot), keys, "left_semi"))
    rest = x.join(F.broadcast(hot), keys, "left_anti")
    return x.join(few, keys).unionByName(rest.join(values, keys))


#: What broadcast_if_small() broadcasts at most.
SMALL_ROWS, SMALL_BYTES = 100_000, 16 << 20


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """df, computed once and checkpointed, with a broadcast hint if it has at most so many rows and bytes.

    Rows and the bytes of their values are counted from the checkpoint, so the plan does not run again.
    """
    df = cut_lineage(df)
    width = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) + 8 if t in ("string", "binary") else F.lit(8) if not t.startswith(("array", "map", "struct")) else F.coalesce(F.octet_length(F.to_json(F.struct(f"`{c}`"))), F.lit(0)) for c, t in df.dtypes), F.lit(8))
    n = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if n["n"] <= rows and n["b"] <= size else df
