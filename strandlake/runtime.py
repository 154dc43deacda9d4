"""Session-level helpers: sessions for tests, lineage cuts, size-checked broadcasts, row numbers."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a table may have, written as JSON, to be broadcast by `join_small`. A row counts as MIN_ROW at least.
BROADCAST_BYTES, MIN_ROW = 8 << 20, 16

#: Whether a query's shuffle files are deleted when it ends; else they stay until the driver collects its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SHIPPED: set[str] = set()
_OWNED: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as tests and the bench use it. On a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make the package importable in the session's Python workers, wherever the driver was started from.

    Writes a zip of it to the shared folder once per application, from which Spark hands it to the workers.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(base, f), os.path.relpath(os.path.join(base, f), os.path.dirname(root)))
    path = os.path.join(own_dir(spark), "code", uuid.uuid4().hex, f"{os.path.basename(root)}.zip")
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(body.getvalue()))
    out.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where it is unset and the master is local, as in tests, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    said = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if said:
        return said
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="strandlake-")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is deleted when the driver's JVM ends, or by `release`."""
    sc = spark.sparkContext
    path = os.path.join(shared_dir(spark), f"strandlake-{sc.applicationId}")
    if path not in _OWNED:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _OWNED.add(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables that this application has written so far; results that read them end with them."""
    sc = spark.sparkContext
    for part in ("tables", "streams"):
        target = sc._jvm.org.apache.hadoop.fs.Path(os.path.join(own_dir(spark), part))
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    Cuts the lineage and survives the loss of executors; compressed and columnar, so later readers take only
    the columns they need. Shuffle files of the write end with it. The table stays until the application ends or calls `release`.
    """
    spark = df.sparkSession
    path = os.path.join(own_dir(spark), "tables", uuid.uuid4().hex)
    said = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_END) if said is None else spark.conf.set(SHUFFLES_END, said)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that `materialize` made, of which nothing that is still to be read is made."""
    spark = table.sparkSession
    for path in {os.path.dirname(f) for f in table.inputFiles()}:
        if os.path.basename(os.path.dirname(path)) == "tables":
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether `df` has at most `limit` bytes. Reads no more rows than could be that small."""
    limit = BROADCAST_BYTES if limit is None else limit
    most = limit // MIN_ROW
    size = F.greatest(F.octet_length(F.to_json(F.struct("*"))), F.lit(MIN_ROW))
    n, total = df.limit(most + 1).agg(F.count("*"), F.sum(size)).first()
    return n <= most and (total or 0) <= limit


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int | None = None) -> DataFrame:
    """Join with `small`, broadcast only if measuring shows at most `limit` bytes; else a shuffled join under AQE."""
    return big.join(F.broadcast(small) if is_small(small, limit) else small, on, how)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the given total order without a one-task window.

    Range-sorts once, materialises, counts rows per sorted part and adds the offsets. `order` names columns.
    """
    spark = df.sparkSession
    part = materialize(
        df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    )
    from pyspark.sql import Window as W

    sizes = part.groupBy("__part").count()
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition of the sort, so the window over all of them is bounded by the partition count.
    offsets = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return (
        part.join(F.broadcast(offsets), "__part")
        .withColumn(name, (local + F.col("__before") + F.lit(start - 1)).cast("long"))
        .drop("__part", "__before")
    )
