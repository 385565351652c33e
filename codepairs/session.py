"""Session defaults, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side, in rows, that may be broadcast when its size is bounded by
# parameters rather than by the data.
BROADCAST_ROWS = 1_000_000

# A sieve has eight bits and more a key, in maps as long as Spark's bitmap aggregate makes them, up to 32 MB in all.
SIEVE_MAP, SIEVE_BITS = 1 << 15, 1 << 28


def build_session(app: str = "codepairs", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Cluster settings are left to the cluster; ``master`` is for local runs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        local = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
        builder = builder.master(master).config(map=local)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own; on a
    cluster such a folder would be private to one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="codepairs-")
    return _local_scratch[app]


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(scratch_dir(spark), "codepairs", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has stored in the scratch folder; results not yet computed are lost with it."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives Catalyst the
    true size, so that later joins broadcast it only if it is small. ``unsettle`` deletes it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsettle(*tables: DataFrame) -> None:
    """Deletes what ``settle`` stored for these tables; for steps whose every reader is stored itself."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(file) for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a side of at most ``max_rows`` rows, a bound the caller
    has proved; beyond the limit the join strategy stays with Catalyst and AQE."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps that are done, by collecting the handles it knows them by."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sieve(rows: DataFrame, key: Column, wanted: DataFrame, of: Column) -> DataFrame:
    """``rows`` whose ``key`` may be the key ``of`` a row in ``wanted``: all of those that are, and few others.

    For joins that keep a small part of ``rows``, of which the rest then need not be shuffled; the join is to follow.
    What is broadcast is a bitmap of hashes, of bounded size; where keys are too many for it, more rows pass. ``wanted`` is
    gone through twice, so it should be stored.
    """
    bits = min(SIEVE_BITS, max(SIEVE_MAP, 1 << (8 * wanted.count()).bit_length()))

    def place(of_key: Column) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(of_key), F.lit(bits))
        return F.shiftright(at, SIEVE_MAP.bit_length() - 1), at % SIEVE_MAP

    number, bit = place(of)
    maps = wanted.select(number.alias("_number"), bit.alias("_bit")).groupBy("_number").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    number, bit = place(key)
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(bit, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    held = F.getbit(byte, (bit % 8).cast("int")) == 1
    return rows.filter(key.isNotNull()).join(F.broadcast(maps), (number == F.col("_number")) & held, "left_semi")
