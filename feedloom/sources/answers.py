"""Answers of a model that were paid for once, by what was asked.

An answer is stored under a digest of the model's name and the text it was asked with, so it
is found again in any later run, for any feed. Failures and empty answers are not stored: they
are asked again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedloom.functions.fixed import MODEL
from feedloom.functions.response import has_answer
from feedloom.operators.skew import BROADCAST_BYTES, broadcast_if_small, join_by_key
from feedloom.schema import ANSWER
from feedloom.sources.runs import Runs

_STORED = StructType([StructField("digest", StringType()), StructField("answer", StringType())])


@dataclass(frozen=True)
class AnswerStore:
    """Answers in the folder ``path``. One run at a time may add to it."""

    path: str
    model: str = MODEL

    @property
    def _runs(self) -> Runs:
        return Runs(self.path, _STORED)

    def digest(self, text: Column) -> Column:
        """What the answer to ``text`` is stored under; NULL for a missing text."""
        return F.sha2(F.concat(F.sha2(F.lit(self.model), 256), text), 256)

    def known(self, rows: DataFrame, digest: str, spread: list[str] | None, out: str = "_known") -> DataFrame:
        """``rows`` with the stored answer to each in ``out``, NULL where there is none.

        Only buckets that a row can be in are read. Rows of one digest may be many: they are
        dealt out by the columns ``spread``, None telling that each digest comes once.
        """
        spark = rows.sparkSession
        state = self._runs.state(spark)
        asked = rows.select(F.col(digest).alias("digest"))
        stored = self._runs.read(spark, state, self._runs.buckets(asked, state))
        # Should two runs have stored an answer each, all readers see the same one.
        asked = broadcast_if_small(asked.where(F.col("digest").isNotNull()).distinct())
        # Answers are measured by their lengths, which are shuffled in their place.
        size = stored.select("digest", (F.octet_length("answer") + 128).alias("n")).join(asked, "digest", "left_semi")
        fits = size.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= BROADCAST_BYTES
        wanted = stored.join(asked, "digest", "left_semi").groupBy(F.col("digest").alias(digest))
        wanted = wanted.agg(F.min("answer").alias("_json"))
        if spread is None:
            found = rows.join(F.broadcast(wanted) if fits else wanted, digest, "left")
        else:
            found = join_by_key(rows, wanted, [digest], "left", spread, fits)
        return found.withColumn(out, F.from_json("_json", ANSWER)).drop("_json")

    def add(self, answers: DataFrame, digest: str, answer: str) -> None:
        """Store the answers of rows that have one; of equal questions one is."""
        given = answers.where(F.col(digest).isNotNull() & has_answer(F.col(answer)))
        as_json = F.to_json(answer, {"ignoreNullFields": "false"})
        self._runs.add(given.groupBy(F.col(digest).alias("digest")).agg(F.min(as_json).alias("answer")), grouped=True)

    def read(self, spark: SparkSession) -> DataFrame:
        """All answers as ``digest, answer``."""
        return self._runs.read(spark).groupBy("digest").agg(F.from_json(F.min("answer"), ANSWER).alias("answer"))
