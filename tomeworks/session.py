"""Session helpers: tables, the shared folder for cut lineage, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application; in local mode only where workers would not find it by themselves."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    searched = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), sc._jvm.System.getProperty("user.dir")]
    found = str(root) in searched
    if sc.master.startswith("local[") and found:
        return
    target = Path(tempfile.mkdtemp(prefix="tomeworks-"), "tomeworks.zip")  # on the driver, which serves it
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "tomeworks").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where nothing is set and all work is done in one process, a temporary folder is made and set.
    """
    ship(spark)
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tomeworks-")
        spark.conf.set(CHECKPOINT_CONF, found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    fs, target = hadoop_path(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, on whatever store the path is of."""
    fs, target = hadoop_path(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def files_in(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names and sizes of the files of a folder; nothing if there is none."""
    fs, target = hadoop_path(spark, folder)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(target) if s.isFile()} if fs.exists(target) else {}


def bytes_in(spark: SparkSession, path: str) -> int:
    fs, target = hadoop_path(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def version(spark: SparkSession, path: str) -> tuple[int, int]:
    """What changes when a table is written anew: bytes and the time of its last change."""
    fs, target = hadoop_path(spark, path)
    if not fs.exists(target):
        return 0, 0
    return fs.getContentSummary(target).getLength(), max(
        [fs.getFileStatus(target).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(target))]
    )


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/tomeworks/{label}-{uuid.uuid4().hex}"
    fs, target = hadoop_path(spark, path)
    fs.deleteOnExit(target)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of an executor; the files go when the
    application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join in which both sides are sorted, whatever size the planner takes them for.

    It goes by the bytes of a table's files and does not see that rows are exploded, so it broadcasts,
    through the driver, tables many times as large as it may.
    """
    return df.hint("merge")


def small_or_none(df: DataFrame, max_rows: int) -> list | None:
    """The rows of df if there are at most max_rows, else None; reads no more than max_rows + 1."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blank(col):
    """True where a string is null or holds nothing but white space."""
    return F.coalesce(F.trim(F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit("")) == ""


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over as many partitions as there are to work on, where it comes in fewer (a small file); large inputs are left as they are."""
    wanted = max(parallelism(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df
