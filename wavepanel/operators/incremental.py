"""B10/B11 kept up to date wave by wave.

A panel grows by loads: a new wave's answers, or a wave delivered again.  The
store keeps, for each load, its long rows and its families' bounds: first and
last wave with an answered anchor.  Bounds are as small as the families of a
load, and the minimum of minima is the family's first wave, so the panel needs
only the loads' bounds, never a pass over all stored answers to find them.

A load is known by its name: loading it again replaces its rows and bounds
(whole folders, written before they are listed), so a repeated or corrected
delivery counts once.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..plans.survey import MIN_GAP, NA
from .panel import family_waves, join_bounds, panel_first_last


class PanelStore:
    """Long rows and bounds under ``path`` in a shared folder.

    ``long/load=<name>/version=<v>`` and ``bounds/...`` hold the data; the
    table ``loads`` gets a row (load, version, at) after both are written, and
    the latest row of a load is the one that counts: a load that stops half
    way leaves the store as it was, and loading again is safe.  One writer at
    a time.
    """

    LOADS = "load string, version string, at long"

    def __init__(self, spark: SparkSession, path: str, anchor: str, min_gap: int = MIN_GAP, na: str = NA):
        self.spark, self.path, self.anchor, self.min_gap, self.na = spark, path, anchor, min_gap, na

    def _at(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def load(self, name: str, rows: DataFrame) -> None:
        """Store the long rows of a load (any waves, any families)."""
        version = uuid.uuid4().hex
        at = (f"load={name}", f"version={version}")
        rows.write.parquet(self._at("long", *at))
        stored = self.spark.read.schema(rows.schema).parquet(self._at("long", *at))
        family_waves(stored, self.anchor, 0, self.na).write.parquet(self._at("bounds", *at))
        turn = self._loads().count() if self._known() else 0
        (self.spark.createDataFrame([(name, version, turn)], self.LOADS).coalesce(1)
         .write.mode("append").parquet(self._at("loads")))

    def _known(self) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at("loads"))
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def _loads(self) -> DataFrame:
        return self.spark.read.schema(self.LOADS).parquet(self._at("loads"))

    def _current(self, kind: str) -> DataFrame:
        """The counting versions of all loads (one row a load, however many versions)."""
        latest = self._loads().groupBy("load").agg(F.max_by("version", "at").alias("version")).collect()
        paths = [self._at(kind, f"load={r.load}", f"version={r.version}") for r in latest]
        return self.spark.read.parquet(*paths)

    def bounds(self) -> DataFrame:
        """(family, time_first, time_last) over all loads, of the kept families."""
        return (self._current("bounds").groupBy(S.FAMILY)
                .agg(F.min(S.TIME_FIRST).alias(S.TIME_FIRST), F.max(S.TIME_LAST).alias(S.TIME_LAST))
                .filter(F.col(S.TIME_LAST) - F.col(S.TIME_FIRST) >= F.lit(self.min_gap)))

    def long(self) -> DataFrame:
        return self._current("long")

    def periods(self) -> DataFrame:
        """Same rows as ``first_last_wave`` over all stored answers."""
        return join_bounds(self.long(), self.bounds())

    def panel(self) -> DataFrame:
        return panel_first_last(self.periods())
