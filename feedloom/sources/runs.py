"""Rows by key in sorted runs that writers merge as they add to them.

Every addition writes a run. `FAN` runs of one level are merged into one of the next by the
addition that completes them, so after n additions there are fewer than ``FAN`` runs in
each of about log(n) levels. A pointer names the runs that count: a reader sees the state
before an addition or the one after, and a run whose writer failed is never read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.sources import versions

# Runs of a level that are merged into one of the next.
FAN = 4
# The level that rows which replace all others start at.
BASE = 8


def _digits(level: int) -> int:
    """How many digits of a key's hash name the buckets of a run: small runs have none."""
    return min(level // 2, 2)


def bucket_of(key: Column) -> Column:
    """One of at most 256 buckets, whatever the keys look like."""
    return F.substring(F.sha2(key, 256), 1, 2)


@dataclass(frozen=True)
class Runs:
    """The runs in a folder. The first column of ``schema`` is the key, a string."""

    path: str
    schema: StructType

    @property
    def key(self) -> str:
        return self.schema.names[0]

    def state(self, spark: SparkSession) -> dict:
        """What counts now; its ``version`` is 0 if nothing was ever written."""
        return versions.newest(spark, self.path)

    def _write(self, rows: DataFrame, level: int, grouped: bool = False) -> dict:
        name, digits = f"run={uuid.uuid4().hex}", _digits(level)
        rows = rows.select(*self.schema.names, F.substring(bucket_of(F.col(self.key)), 1, digits).alias("bucket"))
        # Sorted, so that a lookup of few keys passes over most row groups.
        laid_out = rows if grouped and not digits else rows.hint("rebalance", "bucket")
        laid_out = laid_out.sortWithinPartitions("bucket", self.key)
        if digits:
            laid_out.write.partitionBy("bucket").parquet(f"{self.path}/runs/{name}", compression="zstd")
        else:
            laid_out.drop("bucket").write.parquet(f"{self.path}/runs/{name}", compression="zstd")
        return {"name": name, "level": level}

    def _publish(self, spark: SparkSession, state: dict, runs: list[dict]) -> None:
        """Let ``runs`` count from now on; what the state before last had is deleted."""
        gone = [run["name"] for run in state.get("runs", []) if run not in runs]
        versions.publish(spark, self.path, state, {"runs": runs, "gone": gone})
        for name in state.get("gone", []):
            versions.remove(spark, f"{self.path}/runs/{name}")

    def read(self, spark: SparkSession, state: dict | None = None, buckets: list[str] | None = None) -> DataFrame:
        """All rows of a state, by default of the present one, or those in these buckets.

        A row that was added twice may come twice.
        """
        runs = (self.state(spark) if state is None else state).get("runs", [])
        found = spark.createDataFrame([], self.schema)
        bucketed = StructType([*self.schema.fields]).add("bucket", "string")
        for digits in sorted({_digits(run["level"]) for run in runs}):
            folders = [f"{self.path}/runs/{run['name']}" for run in runs if _digits(run["level"]) == digits]
            reader = spark.read.schema(bucketed if digits else self.schema).option("basePath", f"{self.path}/runs")
            rows = reader.parquet(*folders)
            if digits and buckets is not None:
                rows = rows.where(F.col("bucket").isin(sorted({b[:digits] for b in buckets})))
            found = found.unionByName(rows.select(*self.schema.names))
        return found

    def buckets(self, keys: DataFrame, state: dict) -> list[str] | None:
        """The buckets of a frame's keys, at most 256; None if no run has buckets."""
        if not any(_digits(run["level"]) for run in state.get("runs", [])):
            return None
        return [row[0] for row in keys.select(bucket_of(F.col(self.key))).distinct().collect()]

    def add(self, rows: DataFrame, grouped: bool = False) -> None:
        """Add rows; ``rows`` without a row add nothing.

        Rows that are ``grouped`` by their key were shuffled just now, and are not again.
        """
        spark = rows.sparkSession
        if rows.select(self.key).isEmpty():
            return
        state = self.state(spark)
        before = state.get("runs", [])
        runs, level = [*before, self._write(rows, 0, grouped)], 0
        while len(same := [run for run in runs if run["level"] == level]) >= FAN:
            merged = self._write(self.read(spark, {"runs": same}).distinct(), level + 1)
            runs, level = [*(run for run in runs if run not in same), merged], level + 1
            for run in same:
                if run not in before:  # merged further in this addition, so it never counted
                    versions.remove(spark, f"{self.path}/runs/{run['name']}")
        self._publish(spark, state, runs)

    def replace(self, rows: DataFrame) -> None:
        """Put ``rows``, which must not read these runs, in the place of all there are."""
        state = self.state(rows.sparkSession)
        self._publish(rows.sparkSession, state, [self._write(rows, BASE)])
