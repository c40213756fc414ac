"""Token counts by rank-synchronous merging of ragged arrays.

A vocabulary of byte pairs merges, in each pre-token, the neighbouring pair of
the lowest rank until no pair has one. Here the pre-tokens of a whole batch lie
one after another in one array of symbols; in each round every sequence merges
its pair of the lowest rank, all at the same time, and what has no pair left
leaves the arrays with its count. The rounds follow the longest sequence, not
the number of sequences.

The vocabulary's own normaliser and pre-tokenizer, read from its file, make the
pre-tokens; they drop white space, so the count of a text is the sum over its
words, and a worker keeps the counts of words in a bounded cache. There is no
shuffle: each row's count is made where the row is.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataform.llm.common import fresh, text_or_empty
from strataform.llm.packing import default_tokenizer

LIMIT = 2048
CACHE_WORDS = 1_000_000
#: Symbols of one call of the merging, and the rank of a pair that has none.
BATCH_SYMBOLS, NO_RANK = 1 << 20, np.iinfo(np.int64).max
#: Characters of texts whose new words are learned together.
GROUP_CHARS = 1 << 20


class Merges:
    """The merge table of a vocabulary file as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.size, self.suffix = len(vocab), suffix
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left, right, made = (np.array([vocab[x] for x in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        # a pair's places may merge in one round only if what they make takes part in later ranks alone
        first = np.full(self.size, NO_RANK)
        ranks = np.arange(len(pairs))
        np.minimum.at(first, left, ranks)
        np.minimum.at(first, right, ranks)
        self.together = first[made] > ranks
        singles = {s: i for s, i in vocab.items() if len(s) == 1}
        top = max(map(ord, singles)) + 1
        self.inner, self.last = np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        for symbol, i in singles.items():
            self.inner[ord(symbol)] = i
            self.last[ord(symbol)] = vocab[symbol + suffix]

    def symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of all pieces in one array, and each piece's length."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        ids, ends = self.inner[points], np.cumsum(lengths) - 1
        ids[ends] = self.last[points[ends]]
        return ids, lengths

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def survivors(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols of each sequence are left when no pair can merge; lengths are at least one."""
        left = lengths.copy()
        names, size = np.arange(len(lengths)), lengths
        while len(names):
            starts = np.cumsum(size) - size
            ranks = np.full(len(ids), NO_RANK)
            ranks[:-1] = self.pair_ranks(ids[:-1], ids[1:])
            ranks[starts + size - 1] = NO_RANK  # a sequence's last symbol has no right neighbour
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest < NO_RANK
            left[names[~going]] = size[~going]
            stay = np.repeat(going, size)
            ids, ranks, names, lowest = ids[stay], ranks[stay], names[going], lowest[going]
            size = size[going]
            if not len(names):
                break
            owner = np.repeat(np.arange(len(names)), size)
            hits = np.flatnonzero(ranks == lowest[owner])
            # of overlapping places (one symbol repeated) every second merges, from the left
            fresh_run = np.ones(len(hits), bool)
            fresh_run[1:] = (np.diff(hits) > 1) | (owner[hits[1:]] != owner[hits[:-1]])
            run_start = np.maximum.accumulate(np.where(fresh_run, hits, 0))
            hits = hits[(hits - run_start) % 2 == 0]
            first = np.ones(len(hits), bool)
            first[1:] = owner[hits[1:]] != owner[hits[:-1]]
            hits = hits[first | self.together[lowest[owner[hits]]]]
            ids[hits] = self.made[ranks[hits]]
            held = np.ones(len(ids), bool)
            held[hits + 1] = False
            ids, size = ids[held], size - np.bincount(owner[hits], minlength=len(names))
        return left


class WordCounts(dict):
    """Tokens of words without spaces and line ends between them, from a bounded cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-pair vocabulary")
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        if "".join(p for p, _ in self.split.pre_tokenize_str("a b\nc")) != "abc":
            raise ValueError(f"{path}: its pre-tokenizer keeps white space")
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        special = [re.escape(t["content"]) for t in spec["added_tokens"] if not t["normalized"]]
        if len(special) < len(spec["added_tokens"]):
            raise ValueError(f"{path}: has added tokens that are looked for after normalising")
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None

    def learn(self, words: list[str]) -> None:
        pieces: list[str] = []
        owners: list[int] = []
        counts = np.zeros(len(words), np.int64)
        symbols = 0

        def merge() -> None:
            nonlocal symbols
            if pieces:
                np.add.at(counts, owners, self.merges.survivors(*self.merges.symbols(pieces)))
                pieces.clear(), owners.clear()
            symbols = 0

        for i, word in enumerate(words):
            parts = [word]
            if self.special and self.special.search(word):
                counts[i] += len(self.special.findall(word))
                parts = self.special.split(word)
            for part in parts:
                if part:
                    for piece, _ in self.split.pre_tokenize_str(self.normal.normalize_str(part) if self.normal else part):
                        pieces.append(piece)
                        owners.append(i)
                        symbols += len(piece)
            if symbols >= BATCH_SYMBOLS:
                merge()
        merge()
        self.update(zip(words, counts.tolist()))

    def of(self, texts: list[str]) -> list[int]:
        """Counts of texts; the new words of a group of bounded size are learned together."""
        found: list[int] = []
        group: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            group.append(text.replace("\n", " ").split(" "))
            size += len(text)
            if size >= GROUP_CHARS or i == len(texts) - 1:
                own = set().union(*group)
                new = [w for w in own if w not in self]
                if new and len(self) + len(new) > CACHE_WORDS:
                    self.clear()
                    new = list(own)
                self.learn(new)
                found += [sum(map(self.__getitem__, words)) for words in group]
                group, size = [], 0
        return found


@functools.cache
def word_counts(path: str) -> WordCounts:
    """One for each vocabulary in a worker, kept from task to task."""
    return WordCounts(path)


def count_tokens(docs: DataFrame, text_col: str = "text", limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """The columns of ``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    Tokens are those of the library without begin and end tokens; special
    strings inside a text count as one token each, the library's default.
    ``tokenizer`` is the path of a byte-pair vocabulary whose pre-tokenizer
    drops white space; others are refused.

    Null or empty text: no bytes, no tokens. Repeated rows and null ids are
    rows like others. Input columns named like the three results are replaced;
    others pass through. An empty table gives an empty table.
    """
    path = tokenizer or default_tokenizer()

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(word_counts(path).of(texts.to_pylist()), pa.int64())

    counted = fresh(docs, "n_bytes", "n_tokens", "over_limit").withColumn("n_bytes", F.octet_length(text_or_empty(text_col)).cast("long"))
    return counted.withColumn("n_tokens", tokens(text_or_empty(text_col))).withColumn("over_limit", F.col("n_tokens") > limit)
