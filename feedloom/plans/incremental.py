"""Aggregates that follow new files: additive cubes kept as tables, one part per batch of rows.

A batch is enriched once, its cubes are written, and every aggregate is then a sum over the parts, so that the work follows
the new rows and not all rows that ever came. The cubes grow with days x themes x segments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import metrics, segments, trends
from feedloom.operators.distinct import estimated_distinct, value_sketches
from feedloom.operators.signals import enrich
from feedloom.session import materialize
from feedloom.vocab import Lexicon, RequestRules, ThemeRules

#: Tables and what they hold; measures of equal keys in different batches add up, sketches merge.
CUBES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "themes": metrics.feedback_cube,
    "volume": trends.day_theme_volume,
    "segments": segments.segment_cube,
    "texts": lambda rows: value_sketches(rows, "original_text", ("platform",)),
}
_LISTED = "batches"


@dataclass(frozen=True)
class CubeTables:
    """The tables below a folder that all executors share."""

    spark: SparkSession
    folder: str

    def add(self, batch: str, clean: DataFrame, *, lexicon: Lexicon | None = None, requests: RequestRules | None = None,
            themes: ThemeRules | None = None, normalise: bool = False) -> None:
        """Enrich the clean rows of a batch and write their cubes.

        A batch that is added again replaces what it wrote before, so a job that failed half-way is simply run again. Readers
        see a batch when all of its cubes are there.
        """
        rows = materialize(enrich(clean, lexicon=lexicon, requests=requests, themes=themes, normalise=normalise))
        for name, cube in CUBES.items():
            cube(rows).write.mode("overwrite").parquet(self._part(name, batch))
        rows.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(self._part(_LISTED, batch))

    def cube(self, name: str) -> DataFrame:
        """The parts of all complete batches; keys may repeat across batches."""
        listed = self.spark.read.parquet(f"{self.folder}/{_LISTED}").select("batch")
        return self.spark.read.parquet(f"{self.folder}/{name}").join(listed, "batch", "left_semi").drop("batch")

    def _part(self, name: str, batch: str) -> str:
        # The name begins with a letter, so that Spark reads it as text whatever it is.
        return f"{self.folder}/{name}/batch=batch-{batch}"

    def volume(self) -> DataFrame:
        """Rows per day and theme, the source of all trends."""
        return self.cube("volume").groupBy("day", "primary_theme").agg(F.sum("feedback_count").alias("feedback_count"), F.sum("negative_count").alias("negative_count"))

    def themes(self, *, period_days: int = 14) -> DataFrame:
        return metrics.theme_summary(self.cube("themes"), period_days=period_days)

    def daily(self) -> DataFrame:
        return trends.daily_volume(self.volume())

    def weekly(self) -> DataFrame:
        return trends.weekly_volume(self.volume())

    def trends(self, *, period_days: int = 14) -> DataFrame:
        return trends.theme_trends(self.volume(), period_days=period_days)

    def segments(self, *, limit: int = 6) -> DataFrame:
        return segments.insights_of_cube(self.cube("segments"), limit=limit)

    def distinct_texts(self) -> DataFrame:
        """Per platform, rows and the estimated number of distinct texts of all batches; see ``distinct.SKETCH_ERROR``."""
        return estimated_distinct(self.cube("texts"), ("platform",))
