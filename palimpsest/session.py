"""Session helpers and durable intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (`spark.checkpoint.dir`), which all executors can read.

    Only a local session without one gets a temporary folder, which goes when Python ends; a cluster
    without one is an error, because a machine-local folder would not be readable from other executors.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        if configured is None:
            configured = tempfile.mkdtemp(prefix="palimpsest-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def durable(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write `df` as a table into the shared folder and read it back.

    That cuts the lineage, survives lost executors, and gives later joins the true size. The table
    makes no claim about how its rows are partitioned, unlike a checkpointed plan, whose recorded
    partitioning later unions would rely on. `codec`: zstd halves hashes in hex, which the session's own may not.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Actions inside send Python workers batches of at most `rows` rows and about `size` bytes. Nothing may be left to run later.

    Both sides of the pipe hold whole batches, outside the JVM's heap and in each worker.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in limits}
    for key, most in limits.items():
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, own in before.items():
            spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt out by key to as many tasks as the session has shuffle partitions.

    The number is given, so adaptive execution keeps it: it would put partitions together by their compressed bytes,
    which for repetitive rows are far fewer than those that a task then sorts.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *[F.col(f"`{k}`") for k in keys])


def large(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A side of a join on `keys` that grows with the data: dealt out, and merged instead of sent to every task.

    Spark takes such a side for small where files are well compressed or rows were unfolded from lists, and a broadcast
    passes through the driver.
    """
    return dealt(df, keys).hint("merge")
