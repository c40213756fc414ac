"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds
the vectors of its letters, each permuted by its place, by multiplication; a
document bundles its n-grams by addition; a language bundles the unit vectors
of its documents. A document has the language whose prototype has the largest
cosine with it.

Learning reads a hash sample of each language's documents, ``PER_LANGUAGE`` of
them in expectation, and sums vectors as integers where they are, so that the
driver gets one row for each language and dimension and equal inputs give equal
prototypes. Predicting is map-only. Python holds numpy arrays for a document at
a time and a bounded cache of n-gram vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 1024
GRAM = 3
PER_LANGUAGE = 1500
CACHE_GRAMS = 60_000
UNIT = 1 << 20
UNKNOWN = "und"
#: How sharply cosines are told apart in the score.
SHARPNESS = 40.0


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Encoder:
    """Bundles the n-gram vectors of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.d, self.n = dimensions, gram
        self.alpha = _letters()
        self.symbols: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.d), np.int8)

    def _symbol(self, code: int) -> np.ndarray:
        if code not in self.symbols:
            self.symbols[code] = (np.random.Generator(np.random.PCG64(code + 1)).integers(0, 2, self.d, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.symbols[code]

    def _rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the cache that hold these n-grams, which are sorted and distinct."""
        at = np.searchsorted(self.ids, ids)
        known = at < len(self.ids)
        known[known] = self.ids[at[known]] == ids[known]
        if not known.all():
            new = ids[~known]
            if len(self.ids) + len(new) > CACHE_GRAMS:
                self._clear()
                new = ids
            made = np.ones((len(new), self.d), np.int8)
            for place in range(self.n):
                codes, which = np.unique((new >> (21 * (self.n - 1 - place))) & 0x1FFFFF, return_inverse=True)
                made *= np.stack([np.roll(self._symbol(int(c)), self.n - 1 - place) for c in codes])[which]
            ids_all = np.concatenate([self.ids, new])
            order = np.argsort(ids_all, kind="stable")
            self.ids, self.vectors = ids_all[order], np.concatenate([self.vectors, made])[order]
            at = np.searchsorted(self.ids, ids)
        return at

    def encode(self, text: str) -> np.ndarray | None:
        """The document's vector, None without a letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = self.alpha[codes]
        if not letter.any():
            return None
        codes = np.where(letter, codes, 0)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = np.concatenate([[0], codes[keep], [0]])
        grams = np.zeros(max(0, len(codes) - self.n + 1), np.int64)
        for place in range(self.n):
            grams = (grams << 21) | codes[place : place + len(grams)]
        ids, counts = np.unique(grams, return_counts=True)
        total = np.zeros(self.d, np.float32)
        step = CACHE_GRAMS // 4
        for i in range(0, len(ids), step):
            rows = self._rows(ids[i : i + step])
            total += counts[i : i + step].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total


def _bucket(id_col: str, buckets: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % buckets


def learn_prototypes(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a unit vector for each.

    ``learn`` chooses the rows that may be learned from. Of each language about
    ``per_language`` documents are taken by a hash of their id.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not counts:
        return [], np.zeros((0, DIMENSIONS))
    share = docs.sparkSession.createDataFrame([(k, int(min(1.0, per_language / v) * (1 << 30))) for k, v in counts.items()], "__lang string, __share long")
    taken = rows.select(F.col(lang_col).cast("string").alias("__lang"), F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(share), "__lang")
    taken = taken.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1 << 30)) <= F.col("__share")).select("__lang", "__text")

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(), {}
        for batch in batches:
            for i in range(batch.num_rows):
                found = encoder.encode(batch.column(1)[i].as_py())
                norm = 0.0 if found is None else float(np.linalg.norm(found))
                if norm:
                    lang = batch.column(0)[i].as_py()
                    sums[lang] = sums.get(lang, 0) + np.rint(found.astype(np.float64) * (UNIT / norm)).astype(np.int64)
        for lang, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], names=["lang", "place", "value"])

    parts = taken.mapInArrow(summed, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    names = sorted(counts)
    at = {name: i for i, name in enumerate(names)}
    held = np.zeros((len(names), DIMENSIONS))
    for lang, place, value in parts.collect():
        held[at[lang], place] = value
    norms = np.linalg.norm(held, axis=1, keepdims=True)
    return names, held / np.where(norms == 0, 1, norms)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """id, held_out, lang_pred and score of every row.

    Learns from the rows with a language whose crc32(id as text) mod ``folds``
    isn't ``held``; nothing but the text is used to predict. Null texts and
    texts without a letter are ``und`` with score 0, and so is every text where
    there's nothing to learn from. The score is the softmax of the cosines.
    Rows without an id aren't learned from and aren't held out. Repeated rows
    stay; other columns aren't read; an empty table gives an empty one.
    """
    held_out = F.coalesce(_bucket(id_col, folds) == held, F.lit(False))
    names, prototypes = learn_prototypes(docs, ~held_out, id_col, text_col, lang_col)
    matrix = prototypes.astype(np.float32)

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            langs, scores = [], []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                found = encoder.encode(text) if text is not None and len(names) else None
                norm = 0.0 if found is None else float(np.linalg.norm(found))
                if not norm:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = matrix @ (found / norm)
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(float(1.0 / np.exp(SHARPNESS * (cosines - cosines[best])).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("row_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["row_id"]
    return rows.mapInArrow(predicted, f"row_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("row_id", id_col)
