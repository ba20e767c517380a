"""Reading logs, tables and name lists; writing results."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only where that is unset in a local session a temporary folder of this machine is used; on a
    cluster that is an error, as no other machine would see the files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="playmetrics-")
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the written copy.

    For results that several later jobs read: they start from the files, also after executors
    are lost.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_log(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet log, only the wanted columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc_log(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[str],
    part_column: str,
    lower: int,
    upper: int,
    parts: int,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A log in a database, read in ``parts`` ranges of ``part_column`` at once."""
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", part_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", parts)
    )
    for name, value in (options or {}).items():
        reader = reader.option(name, value)
    return reader.load().select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a stated schema."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def read_labelled_lines(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Text lines ``id, x1, ..., xn, label`` to ``id, features array<double>, label``.

    Lines that do not start with a digit (headers) are dropped.
    """
    return labelled_lines(spark.read.text(path), sep)


def labelled_lines(lines: DataFrame, sep: str = ",") -> DataFrame:
    """The same for a DataFrame with a ``value`` column."""
    parts = F.split("value", re.escape(sep))
    return (
        lines.where(F.col("value").rlike("^[0-9]"))
        .select(parts.alias("p"))
        .select(
            F.col("p")[0].cast("bigint").alias("id"),
            F.slice("p", F.lit(2), F.size("p") - 2).cast("array<double>").alias("features"),
            F.element_at("p", -1).cast("double").alias("label"),
        )
    )


def read_names(spark: SparkSession, path: str, copies: int = 15) -> DataFrame:
    """Distinct names of a text file, one per line; ``{0}`` lines expand over 0..copies-1."""
    return expand_names(spark.read.text(path), copies)


def expand_names(lines: DataFrame, copies: int = 15) -> DataFrame:
    """The same for a DataFrame with a ``value`` column."""
    name = F.trim("value")
    template = F.contains(name, F.lit("{0}"))
    numbers = F.when(template, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    return (
        lines.where(name != "")
        .select(name.alias("name"), F.explode(numbers).alias("i"))
        .select(F.replace("name", F.lit("{0}"), F.col("i").cast("string")).alias("name"))
        .distinct()
    )


def write_result(df: DataFrame, path: str, run: str, kind: str = "parquet") -> str:
    """Write a result under ``path/run=<run>``, so runs are kept apart and readable together."""
    target = f"{path.rstrip('/')}/run={run}"
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(target)
    else:
        writer.parquet(target)
    return target


def write_player(events: DataFrame, player: int, path: str) -> str:
    """Export one player's rows."""
    events.where(F.col("player") == player).write.mode("overwrite").parquet(path)
    return path


def write_bucketed_log(events: DataFrame, table: str, buckets: int) -> None:
    """Store a log bucketed and sorted by player and time, so that work grouped by player reads
    it without a shuffle."""
    events.write.bucketBy(buckets, "player").sortBy("player", "ts", "event_id").mode("overwrite").saveAsTable(table)
