"""What several corpus operators share: word splitting, table reading and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words; every other character belongs to one.
GAPS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public tokenizer's file, where the package that holds it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def map_pandas(rows: DataFrame, key: str, run, schema: str) -> DataFrame:
    """mapInPandas whose long `key`, first in `schema`, goes through pandas as a string: next to nulls, a long would become a float."""
    carried = rows.withColumn(key, F.col(key).cast("string")).mapInPandas(run, schema.replace(f"{key} long", f"{key} string", 1))
    return carried.withColumn(key, F.col(key).cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="mezze-")
    return _own_dir[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/mezze/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later stages survive lost executors and nothing is computed twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """`df`, marked for broadcast where it has at most `most` rows; otherwise for Spark to join by a shuffle.

    `df` is counted here: hand over a table that is written down.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")
