"""Query registration: a Spark callable and, where SQL can say the same, its SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROOT = str(Path(__file__).resolve().parent.parent)
DIGITS = 6
#: Settings a session may choose itself: batches to Python workers are bounded by bytes, whatever the length of texts.
UNLESS_SET = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this repository, whatever folder the driver was started in."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for key, value in UNLESS_SET.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six digits: sums of doubles depend on their order in the last ones."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def query(name: str, ctes: str = "", sql: str | None = None, doubles: str = ""):
    """Register a query. ``doubles`` names the double columns of the SQL result, rounded as in Spark."""
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return rounded(build(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            replaced = ", ".join(f'round(CAST("{c}" AS DOUBLE), {DIGITS}) AS "{c}"' for c in doubles.split("|") if c)
            body = f"SELECT * REPLACE ({replaced}) FROM ({sql}) _q" if replaced else sql
            ORACLE[name] = f"WITH {ctes}\n{body}" if ctes else body
        return build

    return register
