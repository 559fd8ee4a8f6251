"""Document quality by a vote of nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import kept, texts
from feedloom.session import materialize

# Bytes as classes: letters (all that is not ASCII counts as one), digits, the rest as is.
_CLASSES = bytes(
    ord("a") if b > 127 or chr(b).islower() else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b
    for b in range(256)
)
_RUN = re.compile(rb"(a|A|0)\1+")
# Signs of a shape up to which it says enough of a token.
_LONG = 12
_TERMS = "label double, sample long, term string, n long"


def terms(text: str) -> Counter:
    """How often each term occurs in a whole text; none in a text without tokens.

    A term is the shape of a token (runs of letters and digits as classes, other signs as
    they are), a step of a long shape's length, or a step of how repetitive the text is, in its tokens and in its lines.
    The steps weigh as much as a sixteenth of the tokens.
    """
    tokens = text.split()
    found: Counter = Counter()
    if not tokens:
        return found
    for shape, n in Counter(text.encode("utf-8", "replace").translate(_CLASSES).split()).items():
        folded = _RUN.sub(rb"\1", shape)
        found[folded.decode()] += n
        if len(folded) > _LONG:  # long shapes differ, so they also count by their length
            found[f"\x00long{len(folded).bit_length()}"] += n
    lines = [line for line in text.split("\n") if line.strip()]
    weight = max(1, len(tokens) // 16)
    # Longer texts have a smaller share of distinct tokens, so it is set off by a power.
    distinct = len(set(tokens)) / len(tokens) ** 0.9
    found[f"\x00tokens{min(8, int(distinct * 8))}"] = weight
    found[f"\x00lines{min(8, int(len(set(lines)) / len(lines) * 8))}"] = weight
    return found


@dataclass
class Model:
    """Labelled vectors of a latent-semantic space; bounded by the parameters it is fit with."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    #: How many labelled documents each vector's vote stands for, on average of its copies.
    shares: np.ndarray
    neighbours: int
    power: int

    def embed(self, counts: list[Counter]) -> np.ndarray:
        return _unit(_weighted(counts, self.vocabulary, self.weights) @ self.projection)

    def score(self, some: list[str], block: int = 1024) -> np.ndarray:
        """The votes: exact cosines with every labelled vector, block by block."""
        out = np.zeros(len(some))
        k = min(self.neighbours, len(self.labels))
        for first in range(0, len(some), block):
            embedded = self.embed([terms(text) for text in some[first : first + block]])
            cosines = embedded @ self.vectors.T
            nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, nearest, 1), 0).astype(float) ** self.power
            weight *= self.shares[nearest]
            votes, total = (weight * self.labels[nearest]).sum(1), weight.sum(1)
            out[first : first + block] = np.where(total > 0, votes / np.maximum(total, 1e-300), 0.0)
        return np.clip(out, 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _weighted(counts: list[Counter], vocabulary: dict[str, int], weights: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(counts), len(vocabulary)), np.float32)
    for row, found in zip(rows, counts, strict=True):
        for term, n in found.items():
            at = vocabulary.get(term)
            if at is not None:
                row[at] = 1 + np.log(n)
    return _unit(rows * weights)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document's label must not be learned; false for a missing number."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 2048,
    vocabulary_size: int = 2048,
    dimensions: int = 32,
    neighbours: int = 16,
    power: int = 8,
) -> Model | None:
    """Fit the space on at most ``per_class`` labelled documents of either label.

    ``labels`` has ``doc_id, quality``; labels of one number are averaged. The sample is
    those of the smallest hash of ``doc_id``, all of them where there are no more. Where
    there are more, a vote counts for all of its label that it stands for, so that the
    scores do not depend on which label the bound cuts. The
    space is a truncated singular-value decomposition of their weighted term counts.
    Returns None without any labelled document. What reaches the driver is bounded by
    ``per_class`` and ``vocabulary_size``.
    """
    averaged = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("label"))
    )
    chosen = [
        averaged.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for side in (F.col("label") >= 0.5, F.col("label") < 0.5)
    ]
    sides = averaged.agg(F.count_if(F.col("label") >= 0.5), F.count_if(F.col("label") < 0.5)).first()
    chosen = materialize(chosen[0].unionByName(chosen[1]), "quality-chosen")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("label").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch), strict=True)
            found = [(label, i, t, n) for label, i, text in rows for t, n in terms(text).items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.string()),
                    pa.array([f[3] for f in found], pa.int64()),
                ],
                names=["label", "sample", "term", "n"],
            )

    sampled = (
        # At most 2 x per_class rows of two numbers.
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )
    counted = materialize(sampled.mapInArrow(count, _TERMS), "quality-terms")
    common = (
        counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 3")
        .orderBy(F.desc("df"), "term").limit(vocabulary_size)
    ).collect()
    if not common:
        return None
    vocabulary = {row["term"]: at for at, row in enumerate(common)}
    found = counted.where(F.col("term").isin(list(vocabulary))).toPandas()
    counts: dict[int, Counter] = {}
    label_of: dict[int, float] = {}
    for label, sample, term, n in found.sort_values(["sample", "term"]).itertuples(index=False):
        counts.setdefault(sample, Counter())[term] = n
        label_of[sample] = label
    weights = np.log(len(counts) / np.array([row["df"] for row in common])) + 0.1
    rows = _weighted(list(counts.values()), vocabulary, weights.astype(np.float32))
    _, vectors = np.linalg.eigh(rows.T.astype(float) @ rows)
    projection = vectors[:, ::-1][:, :dimensions].astype(np.float32)
    # Copies of a text are one neighbour with their mean label.
    embedded, same = np.unique(np.round(_unit(rows @ projection), 6), axis=0, return_inverse=True)
    given = np.array(list(label_of.values()))
    stands = np.where(given >= 0.5, max(1.0, sides[0] / per_class), max(1.0, sides[1] / per_class))
    votes, copies = np.bincount(same.ravel(), stands), np.bincount(same.ravel())
    mean = np.bincount(same.ravel(), stands * given) / votes
    return Model(vocabulary, weights.astype(np.float32), projection, embedded, mean, votes / copies, neighbours, power)


def scorer(docs: DataFrame, model: Model | None):
    """A function of a text column: the probability of quality. 0.5 without a model."""
    if model is None:
        return lambda text: F.lit(0.5)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        kept(("quality",), dict)  # nothing, in the place of what another stage has kept
        return pd.Series(sent.value.score([text or "" for text in column]))

    return score


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``.

    Only labels of documents that are not `held_out` are learned, and only texts are
    scored. A null or blank text has no neighbours and scores 0; rows that repeat, or have
    no number, are scored like any other; other columns are not read. Scoring is one pass
    without a shuffle.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), **options)
    return docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        scorer(docs, model)(F.col("text").cast("string")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), **options)
    return docs.where(scorer(docs, model)(F.col("text").cast("string")) >= threshold)
