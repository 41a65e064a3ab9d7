"""Sending this package to the Python workers of a session."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package: once per application, as `spark-submit --py-files` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="mezze-ship-")
    shutil.copytree(root, f"{folder}/src/mezze", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/mezze", "zip", f"{folder}/src"))
    _shipped.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _own_dir.setdefault(app, _own_dir.get(app) or tempfile.mkdtemp(prefix="mezze-"))
    return f"{shared.rstrip('/')}/mezze/{name}-{uuid.uuid4().hex}"
