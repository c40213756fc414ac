"""Best-fit packing of documents into sequences of a fixed number of tokens.

The histogram of piece lengths, at most one count for each length up to the
capacity, is all that the driver sees. A configuration linear program over it,
cover every length with as few configurations as possible, is solved by
multiplicative weights: a knapsack dynamic program prices the configuration of
the largest weight, whose lengths then lose weight. The fractional solution is
rounded down, largest pieces first; what is left, and the room that is left in
a configuration, is taken by best fit. The plan's size depends on the
histogram alone, never on the number of documents.

Pieces are numbered within their length by a salted window, so that a length
that a third of all pieces have is numbered in many tasks, and a piece's number
and length give its sequence and offset by one binary search in the plan.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strataform.llm.common import text_or_empty, written

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 1_000_000
#: Lengths are priced in classes of this many tokens.
GRID = 8
#: The share of a length's demand that one pricing round covers at most, and how fast covered lengths lose weight.
STEP, RATE = 0.2, 6.0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Token ids of space-separated words as little-endian bytes, from a bounded cache.

    The vocabulary's pre-tokenizer drops white space and never joins what it
    separates, so the ids of a text are those of its words in turn.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def of(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        new = [w for w in set(words) if w not in self]
        if new:
            if len(self) + len(new) > CACHE_WORDS:
                self.clear()
                new = list(set(words))
            for word, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                self[word] = array("I", found.ids).tobytes()
        return b"".join(map(self.__getitem__, words))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each vocabulary in a worker, kept from task to task."""
    return WordIds(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document.

    A document is its token ids and one end id; null and empty texts are the
    end id alone. Only documents longer than the capacity are cut.
    """
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = array("I", [END_ID]).tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc_id, ids = batch.column(0)[i].as_py(), words.of(batch.column(1)[i].as_py()) + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(cut, PIECES)


def price(values: np.ndarray, room: int) -> list[int]:
    """The classes of the most valuable configuration; values[c]: of a piece of c units, 0 where there is none."""
    best = np.zeros(room + 1)
    took = np.zeros(room + 1, np.int64)
    offer = np.where(values > 0, values, -1.0)
    for c in range(1, room + 1):
        gain = offer[1 : c + 1] + best[c - 1 :: -1] if c > 1 else offer[1:2] + best[:1]
        at = int(gain.argmax())
        if gain[at] > best[c - 1]:
            best[c], took[c] = gain[at], at + 1
        else:
            best[c] = best[c - 1]
    found, c = [], room
    while c > 0:
        if took[c]:
            found.append(int(took[c]))
            c -= took[c]
        else:
            c -= 1
    return found


def solve(demand: np.ndarray, room: int) -> dict[tuple[int, ...], float]:
    """A fractional cover of the class demands by configurations, by multiplicative weights."""
    weight = (demand > 0).astype(float)
    cover = np.zeros(len(demand))
    need = np.maximum(demand, 1).astype(float)
    found: dict[tuple[int, ...], float] = {}
    while (weight > 0).any():
        values = np.zeros(room + 1)
        values[: len(weight)] = weight / need
        config = tuple(sorted(price(values, room), reverse=True))
        classes, times = np.unique(config, return_counts=True)
        step = STEP * float((need[classes] / times).min())
        found[config] = found.get(config, 0.0) + step
        gain = step * times / need[classes]
        cover[classes] += gain
        weight[classes] *= np.exp(-RATE * gain)
        weight[cover >= 1.0 - 1e-9] = 0.0
    return found


class Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.below = np.arange(len(counts))

    def largest(self, at_most: int) -> int:
        """The largest length in stock up to ``at_most``, 0 if there's none."""
        at = at_most
        trail = []
        while at > 0 and not self.left[at]:
            trail.append(at)
            nxt = int(self.below[at])
            at = nxt if nxt < at else at - 1
        for t in trail:
            self.below[t] = at
        return max(at, 0)


def make_plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Configurations of exact lengths and how often each is used; together they hold every piece once."""
    room = capacity // GRID
    classes = -(-np.arange(len(counts)) // GRID)
    demand = np.zeros(room + 1, np.int64)
    np.add.at(demand, np.minimum(classes, room), counts)
    demand[0] = 0
    solution = sorted(solve(demand, room).items(), reverse=True)
    stock = Stock(counts)
    plan: list[tuple[list[int], int]] = []

    def use(wanted: tuple[int, ...], limit: int) -> int:
        """One configuration, as often as limit and stock allow; all but the last class as wanted, the rest by best fit."""
        free, chosen = capacity, []
        taken: dict[int, int] = {}

        def take(length: int) -> None:
            nonlocal free
            chosen.append(length)
            taken[length] = taken.get(length, 0) + 1
            free -= length

        for c in wanted[:-1] if len(wanted) > 1 else wanted:
            spare = [(int(stock.left[n]) - taken.get(n, 0), n) for n in range(max(1, (c - 1) * GRID + 1), c * GRID + 1) if n <= free]
            spare = [x for x in spare if x[0] > 0]
            if not spare:
                continue
            take(max(spare)[1])
        while free:
            length = stock.largest(free)
            while length and stock.left[length] <= taken.get(length, 0):
                length = stock.largest(length - 1)
            if not length:
                break
            take(length)
        if not chosen:
            return 0
        times = min([limit, *(int(stock.left[n]) // t for n, t in taken.items())])
        for n, t in taken.items():
            stock.left[n] -= t * times
        plan.append((chosen, times))
        return times

    for config, amount in solution:
        left = int(amount)
        while left > 0:
            # a configuration whose largest class has run out is left to best fit
            top = config[0]
            if not stock.left[max(1, (top - 1) * GRID + 1) : top * GRID + 1].any():
                break
            left -= use(config, left)
    while True:
        top = stock.largest(capacity)
        if not top:
            return plan
        use((-(-top // GRID),), int(stock.left[top]))


def plan_arrays(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Slots by length and first number: which sequence and offset the pieces from that number on have."""
    slots, base = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            slots.append((n, times, base, offset))
            offset += n
        base += times
    slots.sort()
    length, times, first, offset = (np.array(x, np.int64) for x in zip(*slots)) if slots else (np.zeros(0, np.int64),) * 4
    ends = np.cumsum(times)
    group = np.searchsorted(length, length, "left")
    before = ends - times
    return {"length": length, "number": before - before[group] if len(length) else before, "sequence": first, "offset": offset}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Each piece (with a ``length`` from 1 to the capacity) with its sequence_id and offset.

    Equal pieces are told apart by any order; repeated rows are pieces of their
    own. An empty table gives an empty one.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # one row for each length
        counts[r["length"]] = r["count"]
    arrays = plan_arrays(make_plan(counts, capacity))
    keys = (arrays["length"] << 44) + arrays["number"]
    spark = pieces.sparkSession
    held = spark.sparkContext.broadcast((keys, arrays["number"], arrays["sequence"], arrays["offset"]))

    total = int(counts.sum())
    salts = max(16, math.isqrt(total))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    first = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")
    first = first.select(F.col("length").alias("__length"), F.col("__salt").alias("__s"), before.alias("__before"))
    by = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    numbered = salted.withColumn("__at", F.row_number().over(by) - 1).join(first, (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__s")))
    numbered = numbered.select(*pieces.columns, (F.col("__before") + F.col("__at")).alias("__number"))
    schema = numbered.drop("__number").schema.add("sequence_id", "long").add("offset", "long")

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number, sequence, offset = held.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = t["length"].to_numpy(), t["__number"].to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            t = t.drop_columns(["__number"]).append_column("sequence_id", pa.array(sequence[at] + rank - number[at])).append_column("offset", pa.array(offset[at]))
            yield from t.to_batches()

    return numbered.mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Cut and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty; null ids are kept; repeated rows are packed as often
    as they stand; other columns aren't read.
    """
    return pack(written(cut_pieces(docs, id_col, text_col, capacity, tokenizer), "pieces"), capacity)
