"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from orderloom.sources.files import delete

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: merges small shuffle partitions, splits hot ones, and turns a
    # shuffled join into a broadcast one when the measured side is small enough.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Per-order streaming state with timers needs this store.
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str, settings: dict[str, str] | None = None, master: str | None = None) -> SparkSession:
    """A session with the defaults above. Storage endpoints and credentials come in through
    ``settings`` (for example ``spark.hadoop.fs.s3a.endpoint``), never from code."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a local folder only for local sessions without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="orderloom-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts lineage so that several writes see the same rows, survives the loss of executors,
    and gives the planner real file sizes to choose joins by.
    """
    return staged_at(df, scratch_path(df.sparkSession, label))


def staged_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one run, removed together at its end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = scratch_path(spark, "run")
        self.taken = 0

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        self.taken += 1
        return staged_at(df, f"{self.root}/{self.taken}-{label}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.root)
