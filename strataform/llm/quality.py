"""A quality classifier from compressed sizes.

One zstandard dictionary is trained on good texts, one on bad ones. A text is
compressed with either, block by block, so that the dictionaries count
throughout long texts. The difference of the two sizes over the larger one is
the evidence; a logistic curve over it, and over the share of the text that the
better dictionary leaves (repetition leaves little, noise much), calibrates it
to the probability of a good label.

The dictionaries and the curve are learned on a sample of labelled rows that is
bounded by ``PER_CLASS`` rows of each label and ``TRAIN_BYTES`` bytes a row; the
label frequencies that the curve is adjusted to are of all labelled rows that
may be learned from. Scoring is map-only and covers whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from strataform.llm.common import text_or_empty

PER_CLASS = 1500
#: Bytes of a text that it is learned from: of a longer one, blocks spread evenly over all of it.
TRAIN_BYTES = 1 << 15
DICT_BYTES = 110 << 10
BLOCK_BYTES = 1 << 10
LEVEL = 3
KEEP = 0.3


class Sizes:
    """Compressed sizes of a text with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def measures(self, raw: bytes) -> tuple[float, float, float]:
        """Difference (above 0: the good dictionary fits better), log of the share that is left, and its square."""
        good, bad = (sum(len(p.compress(raw[i : i + BLOCK_BYTES])) for i in range(0, len(raw), BLOCK_BYTES)) for p in self.packers)
        left = math.log(min(good, bad) / len(raw))
        return (bad - good) / max(bad, good), left, left * left


class Model:
    """Dictionaries and curve; without samples of both labels, a constant."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", slopes: np.ndarray | None = None, means: np.ndarray | None = None, shift: float = 0.0):
        self.good, self.bad, self.slopes, self.means, self.shift = good, bad, slopes, means, shift

    def scorer(self):
        sizes = Sizes(self.good, self.bad) if self.slopes is not None else None

        def score(raw: bytes) -> float:
            x = self.shift
            if sizes and raw:
                x += float(self.slopes @ (np.array(sizes.measures(raw)) - self.means))
            elif sizes:  # no evidence: a difference of 0, else like the mean text
                x -= float(self.slopes[0] * self.means[0])
            return 1.0 / (1.0 + math.exp(-min(max(x, -500.0), 500.0)))

        return score


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted logistic regression by Newton steps, lightly ridged: slopes, means, shift."""
    means, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    rows = np.column_stack([(x - means) / spread, np.ones(len(x))])
    beta = np.zeros(rows.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        gradient = rows.T @ (weight * (y - p)) - ridge @ beta
        hessian = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge
        step = np.clip(np.linalg.solve(hessian, gradient), -3, 3)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta[:-1] / spread, means, float(beta[-1])


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on all blocks of the texts; of their plain blocks if they are too few to train on."""
    blocks = [t[i : i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICT_BYTES] or b" "


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the labelled rows for which ``learn``, an expression over the id, holds.

    Ids with several different labels aren't learned from; of several texts of
    an id the smallest is. The rows of a label with the smallest id hashes are
    the sample; half of them make its dictionary, half the curve. Long texts are
    learned from by blocks from their whole length; empty ones aren't.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & learn).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("__y"))
    own = own.where(F.col("y") == F.col("__y")).select(F.col(id_col).alias("__id"), F.col("y").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Model(shift=4.0 if 0 not in counts else -4.0) if counts else Model()
    order = F.xxhash64(F.col("__id").cast("string"))
    some = [own.where(F.col("y") == y).orderBy(order, "__id").limit(PER_CLASS) for y in (0, 1)]
    sample = F.broadcast(some[0].union(some[1]))
    texts = docs.select(F.col(id_col).alias("__id"), F.encode(text_or_empty(text_col), "UTF-8").alias("raw")).where(F.length("raw") > 0)
    blocks = TRAIN_BYTES // BLOCK_BYTES
    stride = (F.length("raw") - BLOCK_BYTES) / (blocks - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.substring("raw", (i * stride).cast("int") + 1, F.lit(BLOCK_BYTES)))
    some_of_it = F.aggregate(spread, F.lit(b""), lambda all_, one: F.concat(all_, one))
    texts = texts.withColumn("raw", F.when(F.length("raw") > TRAIN_BYTES, some_of_it).otherwise(F.col("raw")))
    rows = texts.join(sample, "__id").groupBy("__id", "y").agg(F.min("raw").alias("raw")).orderBy(F.xxhash64(F.col("__id").cast("string"), F.lit(1)), "__id").collect()
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows:
        parts[r["y"]].append(bytes(r["raw"]))
    if min(len(p) for p in parts.values()) < 2:
        return Model(shift=math.log((counts[1] + 1) / (counts[0] + 1)))
    good, bad = (_dictionary(parts[y][::2]) for y in (1, 0))
    sizes = Sizes(good, bad)
    x = np.array([sizes.measures(t) for y in (0, 1) for t in parts[y][1::2]])
    n = [len(parts[y][1::2]) for y in (0, 1)]
    y = np.repeat([0.0, 1.0], n)
    total = counts[0] + counts[1]
    weight = np.repeat([counts[0] / total / n[0], counts[1] / total / n[1]], n) * sum(n)
    slopes, means, shift = fit_curve(x, y, weight)
    return Model(good, bad, slopes, means, shift)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the score of their whole text; null texts are empty ones.

    An empty text has the score of a difference of 0 in an otherwise mean text. An input column named
    score is replaced; repeated rows stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != "score"]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = held.value.scorer()
        for texts in batches:
            yield pd.Series([one(t.encode("utf-8", "replace")) for t in texts], dtype="float64")

    return docs.select(*kept).withColumn("score", score(text_or_empty(text_col)))


def held_out(id_col: str = "doc_id", folds: int = 5, held: int = 0) -> Column:
    """Whether crc32(id as text) mod ``folds`` is ``held``; rows without an id aren't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))
