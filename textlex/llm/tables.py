"""Intermediate tables in the folder that the cluster shares, and joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more than this part of all rows, so at most so many keys are.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set and the master is local, as in tests, one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        given = tempfile.mkdtemp(prefix="textlex-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def folder(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/textlex-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table of the shared folder and read again: it cuts the lineage and outlives executors."""
    return written_at(df, name)[0]


def clean(spark: SparkSession) -> None:
    """Deletes all intermediate tables of the application, once its results have been written elsewhere."""
    _delete(spark, folder(spark))


def row_key(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df and columns that tell its rows apart, whatever the plan: the place in its files. Other tables than scans are written first."""
    try:
        of = df.metadataColumn("_metadata")
        key = [of.getField("file_path"), of.getField("row_index")]
        df.select(*key)
    except AnalysisException:
        df = written(df, "rows")
        of = df.metadataColumn("_metadata")
        key = [of.getField("file_path"), of.getField("row_index")]
    return df, [F.xxhash64(key[0]), F.xxhash64(F.lit(1), key[0]), key[1]]


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with groups (one row for each key, `size` rows of `rows` having it), left or inner.

    Groups with more than a thousandth of all `total` rows (a thousand of them at most) are broadcast, so that their rows
    stay where they are; the rest are joined by a shuffle, whatever their size.
    """
    hot = groups.filter(F.col(size) * HOT_SHARE > total)
    cold = groups.filter(F.col(size) * HOT_SHARE <= total)
    columns = [*rows.columns, *[c for c in groups.columns if c not in keys]]
    of_hot = rows.join(F.broadcast(hot), keys).select(*columns)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return of_hot.unionByName(rest.join(cold.hint("merge"), keys, how).select(*columns))
