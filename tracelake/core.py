"""Table access, durable intermediate tables and code shipping shared by every module."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL_DIRS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    into = tempfile.mkdtemp(prefix="ship-")
    archive = os.path.join(into, "tracelake_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(folder, f)
                    z.write(p, os.path.join("tracelake", os.path.relpath(p, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
    atexit.register(shutil.rmtree, into, True)


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only on one machine, where that setting may be unset, a folder of our own is made; on a cluster it must be set.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="tracelake-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], True)
    return _LOCAL_DIRS[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs no recomputation of what came before.
    Parquet keeps the copy compressed and lets later steps read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracelake_path = path  # for drop_materialized
    return out


def drop_materialized(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` once nothing reads it any more."""
    path = getattr(df, "_tracelake_path", None)
    if not path:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def delivered_once(df: DataFrame, key: str, order: str = "ingested_at") -> DataFrame:
    """Keep the first delivered copy of each ``key``; rows with a null key are all kept.

    Narrow tables only: every remaining column goes through the shuffle, so select first.
    """
    cols = [c for c in df.columns if c != key]
    kept = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by(F.struct(*cols), F.struct(F.col(order).isNull(), F.col(order))).alias("_r"))
        .select(key, *[F.col(f"_r.`{c}`").alias(c) for c in cols])
        .select(*df.columns)
    )
    return kept.unionByName(df.where(F.col(key).isNull()))


def latest(df: DataFrame, key: str, order: str = "ingested_at") -> DataFrame:
    """Keep the last delivered version of each ``key`` (later rows correct earlier ones)."""
    cols = [c for c in df.columns if c != key]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*cols), F.struct(F.col(order).isNotNull(), F.col(order))).alias("_r"))
        .select(key, *[F.col(f"_r.`{c}`").alias(c) for c in cols])
        .select(*df.columns)
    )
