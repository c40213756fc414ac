"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are TF-IDF vectors over hashed words, projected
on the leading right singular vectors of passages. A randomised SVD finds these
in two distributed rounds over all distinct passages, each weighed once however
often it is copied: A'(AS) of a sparse random S, and the small (AQ)'(AQ) of its
orthogonalised columns Q. Every task sums its passages' share, the shares are
added by groups, and the driver works on matrices whose size is fixed by
parameters. The leading directions of the items join the basis, ``ITEM_RANK`` at
most: up to that many items are spanned in full, so that their cosines are never
below the plain TF-IDF ones, whatever the passages are.

Every step of every document, and every pair of steps, is compared with every
item by cosine, with a bound that falls with the item's length. A second source
of candidates are runs of words that a text shares with an item: a copy that
lacks words of the item, or has others in their place, always shares one of
``run_length`` words. Candidates of both are checked by the longest common
subsequence of words with the item, and paraphrases also by the words of its answer.

Equal items are searched once. Items are dealt to passes over the texts by their
hash, about ``PASS_ITEMS`` items and ``PASS_WORDS`` words to a pass, and within a
pass to blocks of ``BLOCK_ITEMS``, so what the driver reads and sends to the tasks
is bounded however large the benchmark is: some 2 KB an item of one pass, and a
basis of fixed size. Runs that many items share are met block by block, and some
``HITS_AT_ONCE`` places at once. Texts are parsed once, into tables of word hashes
and of distinct passages in the shared folder; only the passages are shuffled,
besides results and sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataform.llm.common import text_or_empty, written
from strataform.llm.near_dups import words_of

SLOTS = 1 << 14
#: Words between the starts of two passages; a passage is two such steps.
STRIDE = 24
RANK, SPARE = 224, 16
ITEM_RANK, BLOCK_ITEMS = 200, 512
#: Items and words that a pass over the texts takes on average; items are dealt to passes by their hash.
PASS_ITEMS, PASS_WORDS = 2048, 1 << 19
#: Places of items at shared word runs that are made together.
HITS_AT_ONCE = 1 << 18
#: The bound of items of two steps or more; it falls with the root of a shorter item's words.
COSINE = 0.5
COPY, PARAPHRASE, ANSWER = 0.8, 0.65, 0.8
GROUP_WORDS = 100_000
#: Bits of the filter before the lookup of a word run.
RUN_BITS = 20
#: Rows of a share of the sum that travel together.
PART = 256
#: Words whose shares of the sketch are made together, few enough for a core's cache.
WORDS_AT_ONCE = 512
#: Chunks of passages whose sum is kept in single precision, before it goes to the task's sum in double.
FLUSH = 64


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the 31-bit word hashes of each text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), words_of(text_or_empty(text_col)).alias("words"))
    return rows.select("id", F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("hashed"))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about GROUP_WORDS words: first row, row after the last, words, ends of the rows among them."""
    column = batch.column(batch.schema.get_field_index("hashed"))
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    row = 0
    while row < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[row] + GROUP_WORDS, "right")) - 1
        last = min(max(last, row + 1), batch.num_rows)
        yield row, last, values[offsets[row] : offsets[last]], offsets[row + 1 : last + 1] - offsets[row]
        row = last


def _steps(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the steps of all rows, and the row of each."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    counts = -(-(ends - starts) // STRIDE)
    row = np.repeat(np.arange(len(ends)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[row] + within * STRIDE, row


def _step_slots(words: np.ndarray, ends: np.ndarray, steps: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The slots of each step's words, a row each; places after the end of a text hold SLOTS."""
    at = steps[:, None] + np.arange(STRIDE)
    return np.where(at < ends[row][:, None], words[np.minimum(at, len(words) - 1)] & (SLOTS - 1), SLOTS)


def passage_table(table: DataFrame) -> DataFrame:
    """The distinct steps of all rows as the 16-bit slots of their words, and how often each stands."""

    def taken(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, ends in _groups(batch):
                if len(words):
                    slots = _step_slots(words, ends, *_steps(ends)).astype("<u2")
                    yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * STRIDE), len(slots), [None, pa.py_buffer(slots.tobytes())]).cast(pa.binary())], names=["slots"])

    return table.select("hashed").mapInArrow(taken, "slots binary").groupBy("slots").agg(F.count(F.lit(1)).alias("n"))


def _slots(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("slots"))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    return np.frombuffer(column.buffers()[2], "<u2", batch.num_rows * STRIDE, offsets[0]).reshape(-1, STRIDE)


def passage_frequencies(passages: DataFrame) -> tuple[np.ndarray, float]:
    """In how many steps each slot occurs, and the number of steps; over all rows."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS + 1, np.int64)
        total = 0
        for batch in batches:
            times = batch.column(batch.schema.get_field_index("n")).to_numpy()
            slots = np.sort(_slots(batch), axis=1)
            first = np.ones(slots.shape, bool)
            first[:, 1:] = slots[:, 1:] != slots[:, :-1]
            held += np.bincount(slots[first], np.repeat(times, first.sum(axis=1)), minlength=SLOTS + 1).astype(np.int64)
            total += int(times.sum())
        held[SLOTS] = total
        slots = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(held[slots])], names=["slot", "n"])

    found = np.zeros(SLOTS + 1)
    for r in passages.mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        found[r["slot"]] = r["n"]
    return found[:SLOTS], float(found[SLOTS])


def _added(passages: DataFrame, share: Callable[[np.ndarray, np.ndarray], None], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all passages of what ``share`` adds to it for some of them, added by parts of PART rows."""
    rows, width = shape

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part, chunks = np.zeros(shape), np.zeros(shape, np.float32), 0
        for batch in batches:
            slots = _slots(batch)
            for i in range(0, len(slots), 2048):
                share(slots[i : i + 2048], part)
                chunks += 1
                if chunks % FLUSH == 0:
                    total += part
                    part[:] = 0
        total += part
        for number in range(-(-rows // PART)):
            block = total[number * PART : (number + 1) * PART].astype(np.float32)
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["part", "share"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_buffer(), np.float32).astype(np.float64) for s in group["share"])
        return pa.table({"part": group["part"].slice(0, 1), "share": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = np.zeros(shape, np.float32)
    # a task's share is as large as the sum: as many tasks as cores, not as partitions
    passages = passages.coalesce(max(1, passages.sparkSession.sparkContext.defaultParallelism))
    for r in passages.mapInArrow(shared, "part int, share binary").groupBy("part").applyInArrow(added, "part int, share binary").collect():
        block = np.frombuffer(r["share"], np.float32).reshape(-1, width)
        out[r["part"] * PART : r["part"] * PART + len(block)] = block
    return out


def plain(values: np.ndarray) -> np.ndarray:
    """The same single-precision values under numpy's own type object: arrays that were pickled bring a copy of it, with which ``add.at`` takes ten times as long."""
    return values.view(np.float32)


def summed(project: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The sum of the rows of ``project`` at each row of slots."""
    out = np.empty((len(slots), project.shape[1]), np.float32)
    taken = np.empty((64, project.shape[1]), np.float32)
    for i in range(0, len(slots), 64):
        part = slots[i : i + 64]
        own, more = out[i : i + 64], taken[: len(part)]
        np.take(project, part[:, 0], axis=0, out=own, mode="clip")
        for k in range(1, part.shape[1]):
            np.take(project, part[:, k], axis=0, out=more, mode="clip")
            own += more
    return out


def _vector(words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(SLOTS, np.float32)
    np.add.at(v, words & (SLOTS - 1), idf[words & (SLOTS - 1)])
    n = np.linalg.norm(v)
    return v / n if n else v


def orthonormal(rows: np.ndarray, least: float, most: int) -> np.ndarray:
    """The leading right singular vectors of ``rows``, as rows: ``most`` at most, of singular values over ``least``."""
    square, turn = np.linalg.eigh(rows @ rows.T)
    kept = np.flatnonzero(square > least**2)[::-1][:most]
    return (turn[:, kept] / np.sqrt(square[kept])).T.astype(np.float32) @ rows


def _by_slot(basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A row of weighted basis for each slot, side by side in memory; the row after the last stands for no word."""
    out = np.zeros((SLOTS + 1, len(basis)), np.float32)
    np.multiply(basis.T, idf[:, None], out=out[:SLOTS])
    return out


def latent_basis(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors of all distinct passages, as rows."""
    width = rank + SPARE
    draw = np.random.Generator(np.random.PCG64(7))
    column, sign = np.append(draw.integers(0, width, SLOTS), 0), np.append(draw.choice([-1.0, 1.0], SLOTS), 0.0).astype(np.float32)
    held = passages.sparkSession.sparkContext.broadcast(np.append(idf, np.float32(0)))

    def norms(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = plain(held.value)[slots]
        return value, np.maximum(np.einsum("ij,ij->i", value, value), 1e-9)

    def sketched(slots: np.ndarray, total: np.ndarray) -> None:
        # a word's slot, and the column and sign that each word of its passage has in the sparse random matrix;
        # in the order of slots, so that sums which follow each other lie in the same row
        value, square = norms(slots)
        own, others, columns = (value / square[:, None]).ravel(), value * sign[slots], column[slots]
        flat = slots.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[: np.searchsorted(flat, SLOTS, sorter=order)]
        for i in range(0, len(order), WORDS_AT_ONCE):
            at = order[i : i + WORDS_AT_ONCE]
            row = at // slots.shape[1]
            keys = columns[row] + flat[at].astype(np.int64)[:, None] * width
            np.add.at(total.reshape(-1), keys.ravel(), plain(others[row] * own[at][:, None]).ravel())

    sketch = np.ascontiguousarray(_added(passages, sketched, (SLOTS, width)).T)
    sketch /= max(1e-30, float(np.abs(sketch).max()))
    # twice, as the squares that the first is made of lose half of the digits
    q = orthonormal(orthonormal(sketch, 1e-4, width), 0.5, width)
    width = len(q)
    turned = passages.sparkSession.sparkContext.broadcast(_by_slot(q, idf))

    def squared(slots: np.ndarray, total: np.ndarray) -> None:
        rows = summed(plain(turned.value), slots) / np.sqrt(norms(slots)[1])[:, None]
        total += rows.T @ rows

    small = _added(passages, squared, (width, width))
    held.destroy()
    turned.destroy()
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return vectors[:, ::-1][:, :rank].T.astype(np.float32) @ q


def with_items(basis: np.ndarray, items: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """An orthonormal basis, as rows, of the leading directions of the items' vectors and of ``basis``."""
    lead = np.zeros((0, SLOTS), np.float32)
    for i in range(0, len(items), ITEM_RANK):
        more = np.stack([_vector(w, idf) for w in items[i : i + ITEM_RANK]])
        rows = np.concatenate([lead, more])
        square, turn = np.linalg.eigh(rows @ rows.T)
        # rows of the length of their singular values, so that the next items are weighed against these
        lead = turn[:, square > 1e-6][:, ::-1][:, :ITEM_RANK].T.astype(np.float32) @ rows
    own = orthonormal(lead, 1e-3, ITEM_RANK)
    rest = basis - (basis @ own.T) @ own
    return np.concatenate([own, orthonormal(rest, 1e-2, len(rest))])


def run_length(size: int) -> int:
    """The words of a run that any text shares with an item of ``size`` words if it has COPY of them in order and none between them but in place of missing ones."""
    kept = math.ceil(round(COPY * size, 9))
    return -(-kept // (size - kept + 1))


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on; too few at the end give none."""
    n = max(0, len(words) - k + 1)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = (total ^ words[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


class RunIndex:
    """The places of word runs in items."""

    def __init__(self, items: list[np.ndarray]):
        self.by: list[tuple] = []
        self.longest = max(map(len, items))
        lengths = np.array([run_length(len(w)) for w in items])
        for k in np.unique(lengths).tolist():
            own = [(j, _runs(items[j], k)) for j in np.flatnonzero(lengths == k)]
            keys = np.concatenate([h for _, h in own])
            order = np.argsort(keys, kind="stable")
            item = np.concatenate([np.full(len(h), j) for j, h in own])
            place = np.concatenate([np.arange(len(h)) for _, h in own])
            known = np.zeros(1 << RUN_BITS, bool)
            known[keys >> np.uint64(64 - RUN_BITS)] = True
            self.by.append((k, known, keys[order], item[order], place[order]))

    def hits(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row, item, and half step of the row at which the item would start, of every shared run; runs that agree in these once, in the order of items."""
        starts = np.concatenate([[0], ends[:-1]])
        found = [np.zeros(0, np.int64)]
        # one number for the three: no half step is further from 0 than this
        far = (int(ends[-1]) + self.longest) // (STRIDE // 2) + 1
        for k, known, keys, item, place in self.by:
            hashed = _runs(words, k)
            at = np.flatnonzero(known[hashed >> np.uint64(64 - RUN_BITS)])
            row = np.searchsorted(ends, at, "right")
            inside = at + k <= ends[row]
            at, row = at[inside], row[inside]
            low, high = (np.searchsorted(keys, hashed[at], side) for side in ("left", "right"))
            upto = np.cumsum(high - low)
            first = 0
            while first < len(at):
                before = upto[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(upto, before + HITS_AT_ONCE, "right")))
                times = (high - low)[first:last]
                which = np.repeat(low[first:last], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                own, begin = np.repeat(row[first:last], times), np.repeat(at[first:last], times) - place[which]
                found.append(np.unique((item[which] * len(ends) + own) * (2 * far) + (begin - starts[own]) // (STRIDE // 2) + far))
                first = last
        which, at = np.divmod(np.unique(np.concatenate(found)), 2 * far)
        return np.stack([which % len(ends), which // len(ends), at - far], axis=1)


def places(pattern: np.ndarray) -> dict[int, int]:
    """For each word of the pattern, a bit at each of its places."""
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | (1 << i)
    return masks


def common_words(masks: dict[int, int], size: int, text: np.ndarray, least: float = 0.0) -> int:
    """Length of the longest common subsequence, bit-parallel; 0 if too few words of the text are the pattern's for ``least``."""
    shared = [m for m in map(masks.get, text.tolist()) if m]
    if len(shared) < least:
        return 0
    full = (1 << size) - 1
    v = full
    for m in shared:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


FOUND = "id long, item_id long, cosine double, lcs_share double, answer_share double, kind string"


def _search(table: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], idf: np.ndarray, basis: np.ndarray, cosine: float) -> DataFrame:
    basis = with_items(basis, [w for _, w, _ in items], idf)
    project = _by_slot(basis, idf)
    goal = np.stack([basis @ _vector(w, idf) for _, w, _ in items])
    goal /= np.maximum(np.linalg.norm(goal, axis=1, keepdims=True), 1e-9)
    del basis
    least = np.array([cosine * min(1.0, len(w) / (2 * STRIDE)) ** 0.5 for _, w, _ in items], np.float32)
    wanted = [(i, places(w), len(w), places(a), len(a)) for i, w, a in items]
    width = BLOCK_ITEMS
    runs = [RunIndex([w for _, w, _ in items[low : low + width]]) for low in range(0, len(items), width)]
    held = table.sparkSession.sparkContext.broadcast((project, goal, least, wanted, runs))
    del project, goal, wanted

    def judged(near: np.ndarray, item: tuple[int, dict[int, int], int, dict[int, int], int]) -> tuple[float, float, str] | None:
        _, wanted, size, answer, answer_size = item
        share = common_words(wanted, size, near, PARAPHRASE * size) / size
        if share < PARAPHRASE:
            return None
        right = common_words(answer, answer_size, near) / answer_size
        if share >= COPY:
            return share, right, "copy"
        return (share, right, "paraphrase") if right >= ANSWER else None

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, goal, least, items, runs = held.value
        project = plain(project)
        for batch in batches:
            out = []
            for first, last, words, ends in _groups(batch):
                if not len(words):
                    continue
                steps, row = _steps(ends)
                latent = summed(project, _step_slots(words, ends, steps, row))
                square = np.einsum("ij,ij->i", latent, latent)
                together = np.flatnonzero(row[1:] == row[:-1])
                square_two = square.copy()
                square_two[together] += square[together + 1] + 2 * np.einsum("ij,ij->i", latent[together], latent[together + 1])
                norm, norm_two = (np.sqrt(np.maximum(x, 1e-9))[:, None] for x in (square, square_two))
                starts = np.concatenate([[0], ends[:-1]])
                best: dict[tuple[int, int], tuple] = {}

                def tried(r: int, j: int, low: int, high: int, likeness: float) -> None:
                    got = judged(words[starts[r] + max(0, low) : min(ends[r], starts[r] + high)], items[j])
                    if got and got[0] > best.get((r, j), (0, -1.0))[1]:
                        best[r, j] = (likeness, *got)

                first_step = np.searchsorted(steps, starts)
                for block, index in enumerate(runs):
                    low = block * width
                    own = goal[low : low + width]
                    likeness = latent @ own.T
                    two = likeness.copy()
                    two[together] += likeness[together + 1]
                    likeness = np.maximum(likeness / norm, two / norm_two)
                    for s, j in zip(*np.nonzero(likeness >= least[low : low + width])):
                        r, j, likely = int(row[s]), low + int(j), float(likeness[s, j])
                        reach, at = items[j][2] // 2, int(steps[s] - starts[r])
                        tried(r, j, at - reach, at + 2 * STRIDE + reach, likely)
                    for r, j, at in index.hits(words, ends):
                        at, size = int(at) * (STRIDE // 2), items[low + j][2]
                        reach = min(size // 2, STRIDE)
                        tried(int(r), low + int(j), at - reach, at + STRIDE // 2 + size + reach, float(likeness[first_step[r] + max(0, at) // STRIDE, j]))
                out += [(batch.column(0)[first + r].as_py(), items[j][0], *b) for (r, j), b in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["id", "item_id", "cosine", "lcs_share", "answer_share", "kind"])

    out = written(table.mapInArrow(found, FOUND), "found")
    held.destroy()
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = COSINE) -> DataFrame:
    """A row for each document and benchmark item that it holds: ids, cosine, shares and kind.

    ``copy``: at least 0.8 of the item's words stand in order near a passage;
    ``paraphrase``: at least 0.65 of them, and 0.8 of its answer, the words of
    its last sentence. Null and empty texts hold nothing; items without words
    are never found; rows without an id are reported with a null id. Repeated
    documents are reported as often, repeated items too. Other columns aren't
    read; an empty table on either side gives an empty one.
    """
    spark = docs.sparkSession
    table = written(word_table(docs, id_col, text_col), "words")
    sentences = F.filter(F.split(text_or_empty(item_text), r"[.!?\n]+"), lambda s: F.length(F.trim(s)) > 0)
    asked = benchmark.select(F.col(item_col).cast("long").alias("id"), text_or_empty(item_text).alias("__t"), F.coalesce(F.get(sentences, F.size(sentences) - 1), F.lit("")).alias("__a"))
    hashed = lambda c: F.transform(words_of(F.col(c)), lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    asked = asked.select("id", hashed("__t").alias("words"), hashed("__a").alias("answer")).where(F.size("words") > 0)
    asked = written(asked.select("id", "words", F.coalesce("answer", F.array().cast("array<int>")).alias("answer")), "items")
    texts = asked.select("words", "answer").distinct()
    texts = written(texts.select(F.monotonically_increasing_id().alias("text_id"), "words", "answer"), "item_texts")
    size = texts.agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("words") + F.size("answer")).alias("words")).first()
    if not size["items"] or table.isEmpty():
        return spark.createDataFrame([], FOUND).withColumnRenamed("id", id_col)
    passages = written(passage_table(table), "passages")
    seen, steps = passage_frequencies(passages)
    idf = (np.log((1.0 + steps) / (1.0 + seen)) + 1.0).astype(np.float32)
    basis = latent_basis(passages, idf)
    passes = max(math.ceil(size["items"] / PASS_ITEMS), math.ceil(size["words"] / PASS_WORDS))
    parts = []
    for number in range(passes):
        dealt = texts.where(F.pmod(F.xxhash64("words", "answer"), F.lit(passes)) == number).collect()  # about PASS_ITEMS of them
        items = [(t["text_id"], np.array(t["words"], np.int32), np.array(t["answer"] or t["words"], np.int32)) for t in dealt]
        parts += [_search(table, items, idf, basis, cosine)] if items else []
    found = reduce(DataFrame.union, parts)
    ids = asked.join(texts, ["words", "answer"]).select("text_id", F.col("id").alias("own_id"))
    found = found.join(ids, found["item_id"] == ids["text_id"])
    return found.select(F.col("id").alias(id_col), F.col("own_id").alias("item_id"), "cosine", "lcs_share", "answer_share", "kind")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose text holds a benchmark item.

    Rows are judged by their texts: of rows that share an id, or have none, only
    those that hold an item go.
    """
    own = F.xxhash64(F.col(id_col), text_or_empty(text_col))
    leaks = find_leaks(docs.select(own.alias("__key"), F.col(text_col).alias("__text")), benchmark, "__key", "__text")
    leaks = written(leaks.select(F.col("__key").alias("__leak")).distinct(), "leaks")
    return docs.join(leaks, own == leaks["__leak"], "left_anti")
