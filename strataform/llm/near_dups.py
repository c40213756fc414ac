"""Near-duplicate detection by improved consistent weighted sampling.

A text is the weighted set of its runs of five words: the weight of a shingle
is its count times the mean smoothed inverse document frequency of its words.
(Frequencies of the shingles themselves would make the members of a large group
of near copies look unlike: what they share would weigh least.) Document
frequencies are counted over all texts in a hashed table of fixed size.

1. Texts with equal words are collapsed to one.
2. Consistent weighted samples of each text are cut into bands; texts that
   agree on a band share a bucket. A pair is a candidate if as many of all its
   samples agree as all but one in 2,000 pairs at the threshold have.
3. Each bucket's leader is paired with its other members, and every distinct
   pair is verified by the exact weighted Jaccard similarity. Verified pairs are
   joined to classes by large-star and small-star rounds.
4. In a bucket of more than one class, the members outside its leader's class
   are compared with all members of other classes. A bucket of more than one
   block is first split into families: the shingles that texts of such buckets
   share, the most frequent last, have a beginning that two similar texts can't
   both do without, so texts that share nothing in it, even by way of others,
   are never compared. What many unlike texts have in common (a passage, a
   notice) comes last and joins no families. A family is compared block by
   block: a task holds two blocks of bounded size, verifies their candidates,
   and returns the links that join classes, fewer than the block has members.
   So no list of pairs is ever made, and no link between classes is lost. A pair
   that shares several buckets is compared in one of them only.
5. The links of both steps are joined to classes again.

Sketching is map-only. The texts move once, to be joined with the texts that
share a bucket (by a sort-merge join at every size: these have no bound); the
shingles of a pair meet in a join. A bucket, class or leader with a third of all
rows makes skewed join keys of plain tables, which adaptive execution splits, or
more blocks. Tables between steps are written to the shared folder, so a lost
executor doesn't start the job anew. The number of jobs doesn't depend on the
size of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataform.llm.common import text_or_empty, written

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 5
#: Entries of the hashed table of document frequencies, and rows of the table of sampling variables.
FREQUENCIES = 1 << 16
VARIABLES = 1 << 14
#: Members and bytes of shingles of a block, on average: two blocks are what a comparison holds.
BLOCK, BLOCK_BYTES = 512, 1 << 24
#: Standard deviations below the threshold at which sample agreement rules a pair out.
SLACK = 3.3
BREAK = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BREAK), "")


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Smoothed inverse document frequencies, 1 to 2, by word hash; over all texts."""
    slots = F.array_distinct(F.transform(words_of(text_or_empty(text_col)), lambda w: F.pmod(F.xxhash64(w), F.lit(FREQUENCIES)).cast("int")))
    counted = docs.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    held = np.zeros(FREQUENCIES)
    for r in counted.collect():  # FREQUENCIES rows at most
        held[r["slot"]] = r["n"]
    total = max(1.0, held.max())
    return (1.0 + np.log((1.0 + total) / (1.0 + held)) / np.log(1.0 + total)).astype(np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their weights. Fewer words than five are one shingle."""
    h = hashes.astype(np.uint64)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    k = min(WORDS, n)
    value = idf[(hashes & (FREQUENCIES - 1)).astype(np.int64)]
    m = n - k + 1
    rolled, weight = np.zeros(m, np.uint64), np.zeros(m, np.float32)
    for i in range(k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[i : i + m])
        weight = weight + value[i : i + m]
    found, at, times = np.unique(_mixed(rolled), return_index=True, return_counts=True)
    return found, (times * weight[at] / k).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling with variables from a fixed table.

    For element and sample: r and c are Gamma(2, 1), b is uniform;
    t = floor(ln w / r + b), and the sample is the element with the smallest
    ln c - r (t - b) - r, together with its t.
    """

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        k = bands * rows
        draw = np.random.Generator(np.random.PCG64(20240131))
        r, c = (draw.gamma(2.0, 1.0, (VARIABLES, k)).astype(np.float32) for _ in range(2))
        self.r, self.b = r, draw.random((VARIABLES, k), np.float32)
        self.inverse = 1.0 / r
        self.level = np.log(c) - r + r * self.b
        self.places = np.arange(k)

    def bands_of(self, ids: np.ndarray, weights: np.ndarray, chunk: int = 2048) -> tuple[list[int], np.ndarray]:
        """A key for each band and a byte for each sample. Shingles are taken by chunks, so long texts need no more memory."""
        k = len(self.places)
        best = np.full(k, np.inf, np.float32)
        chosen, stage = np.zeros(k, np.uint64), np.zeros(k, np.float32)
        for i in range(0, len(ids), chunk):
            own = ids[i : i + chunk]
            at = (own >> np.uint64(40)).astype(np.int64) & (VARIABLES - 1)
            t = self.inverse[at]
            t *= np.log(weights[i : i + chunk])[:, None]
            t += self.b[at]
            np.floor(t, out=t)
            value = self.r[at]
            value *= t
            np.subtract(self.level[at], value, out=value)
            row = value.argmin(axis=0)
            low = value[row, self.places]
            less = low < best
            best = np.where(less, low, best)
            chosen = np.where(less, own[row], chosen)
            stage = np.where(less, t[row, self.places], stage)
        sample = _mixed(chosen ^ _mixed(stage.astype(np.int64).astype(np.uint64))).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + sample[:, j])
        return key.astype(np.int64).tolist(), (sample.ravel() & np.uint64(0xFF)).astype(np.uint8).view(np.int8)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    whole = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / whole if whole else 0.0


def _fingerprint(words: str, text: str) -> list[Column]:
    """128 bits of the words, of the text itself where it has none."""
    n = F.size(words) > 0
    return [F.when(n, F.xxhash64(F.lit(seed), F.col(words))).otherwise(F.xxhash64(F.lit(seed + 100), F.col(text))).alias(name) for seed, name in ((1, "fa"), (2, "fb"))]


def sketch(docs: DataFrame, idf: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id, fa, fb, hash of the text, band keys and sample bytes of every row; no keys and bytes for texts without words."""
    held = docs.sparkSession.sparkContext.broadcast(idf)
    schema = pa.schema([("id", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("raw", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int8()))])

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, idf = Sampler(), held.value
        for batch in batches:
            column = batch.column(4)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            made = [shingles(values[ends[i] : ends[i + 1]], idf) for i in range(batch.num_rows)]
            made = [sampler.bands_of(*m) if len(m[0]) else ([], []) for m in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int8()))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("words", words_of(F.col("text")))
    rows = rows.select("id", *_fingerprint("words", "text"), F.xxhash64("text").alias("raw"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"))
    return rows.mapInArrow(sampled, "id long, fa long, fb long, raw long, bands array<long>, sig array<tinyint>")


def least_agreement(similar: float) -> int:
    """How many samples of a pair of this similarity agree, in all but one case in 2,000."""
    k = BANDS * ROWS
    return int(k * similar - SLACK * (k * similar * (1 - similar)) ** 0.5)


def agree(a: Column, b: Column, similar: float) -> Column:
    """Whether enough samples agree for a pair of this similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) >= least_agreement(similar)


def features(docs: DataFrame, idf: np.ndarray, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """tid, shingles and weights, as bytes, and the whole weight of the ``wanted`` texts: tid, id and raw (the hash of the text) of a row that has it."""
    held = docs.sparkSession.sparkContext.broadcast(idf)
    schema = pa.schema([("tid", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary()), ("whole", pa.float64())])

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            pairs = [shingles(values[ends[i] : ends[i + 1]], held.value) for i in range(batch.num_rows)]
            whole = pa.array([float(p[1].sum(dtype=np.float64)) for p in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0].tobytes() for p in pairs], pa.binary()), pa.array([p[1].tobytes() for p in pairs], pa.binary()), whole], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("raw", F.xxhash64("text"))
    # rows that repeat id and text are one text; the join has put them side by side
    rows = rows.join(wanted.hint("merge"), ["id", "raw"]).dropDuplicates(["id", "raw"])
    rows = rows.select("tid", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashed"))
    return rows.mapInArrow(made, "tid long, ids binary, weights binary, whole double")


def _weighted_set(ids: pa.Array, weights: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids[i].as_buffer(), np.uint64), np.frombuffer(weights[i].as_buffer(), np.float32)


def verify(pairs: DataFrame, feats: DataFrame, similar: float) -> DataFrame:
    """The pairs a, b of at least this weighted Jaccard similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [weighted_jaccard(*(_weighted_set(batch.column(c), batch.column(c + 1), i) for c in (2, 4))) >= similar for i in range(batch.num_rows)]
            t = pa.Table.from_batches([batch.select([0, 1])]).filter(pa.array(good, pa.bool_()))
            yield from t.cast(schema).to_batches()

    left = feats.select(F.col("tid").alias("a"), F.col("ids").alias("a_ids"), F.col("weights").alias("a_w"))
    right = feats.select(F.col("tid").alias("b"), F.col("ids").alias("b_ids"), F.col("weights").alias("b_w"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "a_ids", "a_w", "b_ids", "b_w")
    return both.mapInArrow(kept, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """tid and class (the smallest tid connected with it) of all in a, b.

    Lowest neighbours are written before they are joined, so that the joins are
    of plain tables, whose skewed keys adaptive execution splits.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = written(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("x"), "u", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("tid"), F.col("v").alias("class")).union(edges.select(F.col("v").alias("tid"), F.col("v").alias("class")).distinct())
        mark = now


CELL = ["bucket", "family", "part", "other"]


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, one after the other, from batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(len(CELL))], axis=1)
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        for i, j in zip(starts[:-1], starts[1:]):
            key = tuple(keys[i].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def joining_links(cell: pa.Table, similar: float) -> list[tuple[int, int]]:
    """Verified pairs of a cell's asking rows with its other rows that join their classes, no more of them than that takes."""
    cell = cell.combine_chunks()
    bucket = cell["bucket"][0].as_py()
    tid, group, whole = (cell[c].to_numpy() for c in ("tid", "class", "whole"))
    asks, answers, outside = (cell[c].to_numpy(zero_copy_only=False) for c in ("asks", "answers", "outside"))
    ids, weights = cell["ids"].chunk(0), cell["weights"].chunk(0)
    sig, bands = (cell[c].chunk(0).flatten().to_numpy().reshape(len(tid), -1) for c in ("sig", "bands"))
    left, right = np.flatnonzero(asks), np.flatnonzero(answers)
    least = least_agreement(similar)
    found = []
    for i in range(0, len(left), 32):
        own = left[i : i + 32]
        agreed = (sig[own][:, None, :] == sig[right][None, :, :]).sum(axis=2, dtype=np.int32)
        light, heavy = np.minimum(whole[own][:, None], whole[right]), np.maximum(whole[own][:, None], whole[right])
        good = (agreed >= least) & (group[own][:, None] != group[right]) & (light >= heavy * (similar - 1e-4))
        # two outsiders are met in both orders: once is enough
        good &= ~outside[right][None, :] | (tid[own][:, None] < tid[right])
        a, b = np.nonzero(good)
        found.append(np.stack([own[a], right[b], agreed[a, b]], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    same = bands[pairs[:, 0]] == bands[pairs[:, 1]]
    pairs = pairs[bands[pairs[:, 0], same.argmax(axis=1)] == bucket]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    links = []
    for a, b, _ in pairs[np.argsort(-pairs[:, 2], kind="stable")].tolist():
        x, y = find(int(group[a])), find(int(group[b]))
        if x != y and weighted_jaccard(_weighted_set(ids, weights, a), _weighted_set(ids, weights, b)) >= similar:
            root[x] = y
            links.append((int(tid[a]), int(tid[b])))
    return links


def families(feats: DataFrame, similar: float) -> DataFrame:
    """tid and family of the texts that have a partner to be compared with: similar texts are in one family.

    Shingles are ordered by the number of texts that have them. The last of a
    text's shingles that together weigh less than ``similar`` of it are left out:
    all that two texts share can't lie there if they are similar, so they share a
    shingle before it. A shingle's texts are joined by links to the smallest.
    """
    least = similar - 1e-4

    def exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, weights = _weighted_set(batch.column(1), batch.column(2), i)
                tid = np.full(len(ids), batch.column(0)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(ids.astype(np.int64)), pa.array(weights)], names=["tid", "shingle", "weight"])

    def first_ones(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            ends, fields = column.offsets.to_numpy(), column.values.flatten()
            count, shingle, weight = (f.to_numpy() for f in fields)
            tids, found = [], []
            for i, (tid, whole) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = slice(ends[i], ends[i + 1])
                order = np.lexsort((shingle[own], count[own]))
                behind = np.cumsum(weight[own][order][::-1].astype(np.float64))[::-1]
                found.append(shingle[own][order][behind >= least * whole])
                tids.append(np.full(len(found[-1]), tid, np.int64))
            if tids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tids)), pa.array(np.concatenate(found))], names=["tid", "shingle"])

    parts = feats.select("tid", "ids", "weights").mapInArrow(exploded, "tid long, shingle long, weight float")
    shared = written(parts.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "shared-shingles")
    own = parts.join(shared, "shingle").groupBy("tid").agg(F.collect_list(F.struct("texts", "shingle", "weight")).alias("own")).join(feats.select("tid", "whole"), "tid")
    first = written(own.select("tid", "whole", "own").mapInArrow(first_ones, "tid long, shingle long"), "first-shingles")
    leaders = written(first.groupBy("shingle").agg(F.min("tid").alias("leader"), F.max("tid").alias("__last")).where("leader <> __last").drop("__last"), "leaders")
    links = first.join(leaders, "shingle").where("tid <> leader").select(F.col("leader").alias("a"), F.col("tid").alias("b")).distinct()
    return written(components(links).select("tid", F.col("class").alias("family")), "families")


def links_between_classes(members: DataFrame, classes: DataFrame, texts: DataFrame, feats: DataFrame, similar: float) -> DataFrame:
    """Links a, b that join classes which share a bucket and hold a pair of this similarity."""
    own = members.join(classes, "tid", "left").withColumn("class", F.coalesce("class", "tid"))
    own = own.join(classes.select(F.col("tid").alias("leader"), F.col("class").alias("main")), "leader", "left")
    own = written(own.select("bucket", "tid", "class", (F.col("class") != F.coalesce("main", "leader")).alias("outside")), "placed")

    def sized(rows: DataFrame, *keys: str) -> DataFrame:
        sizes = rows.join(feats.select("tid", F.octet_length("ids").alias("bytes")), "tid").groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.bool_or("outside").alias("mixed")
        )
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
        return written(sizes.where("mixed AND n > 1").select(*keys, blocks), "mixed")

    crowd = written(own.join(sized(own, "bucket"), "bucket").withColumn("family", F.lit(0).cast("long")), "crowd")
    wide = crowd.where("blocks > 1").drop("blocks", "family")
    if not wide.isEmpty():
        full = feats.join(wide.select("tid").distinct().hint("merge"), "tid", "left_semi")
        wide = written(wide.join(families(full, similar), "tid"), "wide")
        wide = wide.join(sized(wide, "bucket", "family"), ["bucket", "family"])
        crowd = written(crowd.where("blocks = 1").unionByName(wide), "crowd")
    full = texts.select("tid", "bands", "sig").join(crowd.select("tid").distinct().hint("merge"), "tid", "left_semi").join(feats.hint("merge"), "tid")
    crowd = crowd.join(full.hint("merge"), "tid").withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    steps = F.sequence(F.lit(0), F.col("blocks") - 1)
    answers = crowd.withColumn("part", F.explode(steps)).withColumn("other", F.col("block")).withColumn("answers", F.lit(True)).withColumn("asks", F.col("outside") & (F.col("part") == F.col("block")))
    asks = crowd.where("outside").withColumn("part", F.col("block")).withColumn("other", F.explode(steps)).where("other <> part").withColumn("answers", F.lit(False)).withColumn("asks", F.lit(True))
    columns = [*CELL, "tid", "class", "whole", "asks", "answers", "outside", "bands", "sig", "ids", "weights"]

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            links = joining_links(cell, similar)
            if links:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    cells = answers.select(*columns).union(asks.select(*columns)).repartition(*CELL).sortWithinPartitions(*CELL)
    return cells.mapInArrow(compared, "a long, b long")


def _classed(docs: DataFrame, id_col: str, text_col: str, similar: float) -> DataFrame:
    """id and raw (the hash of the text) of every row, with those of a row that stands for its class: class_id, class_raw."""
    idf = document_frequencies(docs, text_col)
    sketches = written(sketch(docs, idf, id_col, text_col), "sketches")
    named = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "raw"))).alias("rep")
    texts = sketches.groupBy("fa", "fb").agg(named, F.first("bands").alias("bands"), F.first("sig").alias("sig")).where("rep IS NOT NULL")
    # numbers of texts: any will do, but they must not change, so the table is written with them
    texts = written(texts.select(F.monotonically_increasing_id().alias("tid"), "fa", "fb", F.col("rep.id").alias("rep"), F.col("rep.raw").alias("raw"), "bands", "sig"), "texts")
    rows = texts.select("tid", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("tid").alias("leader"), F.max("tid").alias("__last")).where("leader <> __last").drop("__last")
    members = written(rows.join(written(shared, "shared"), "bucket"), "members")
    asked = members.select("tid").distinct()
    feats = features(docs, idf, texts.join(asked.hint("merge"), "tid", "left_semi").select("tid", F.col("rep").alias("id"), "raw"), id_col, text_col)
    feats = written(feats, "features")

    sigs = written(texts.select("tid", "sig").join(asked.hint("merge"), "tid", "left_semi"), "sigs")
    pairs = members.where("tid <> leader").select(F.col("leader").alias("a"), F.col("tid").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("tid").alias("b"), F.col("sig").alias("b_sig")), "b").join(sigs.select(F.col("tid").alias("a"), F.col("sig").alias("a_sig")), "a")
    pairs = written(pairs.where(agree("a_sig", "b_sig", similar)).select("a", "b"), "pairs")
    links = written(verify(pairs, feats, similar), "links")
    classes = written(components(links), "classes")
    more = written(links_between_classes(members, classes, texts, feats, similar), "links")
    if not more.isEmpty():
        classes = written(components(links.union(more)), "classes")
    texts = written(texts.join(classes, "tid", "left").select("fa", "fb", "rep", "raw", F.coalesce("class", "tid").alias("class")), "classed")
    first = written(texts.groupBy("class").agg(F.min(F.struct("rep", "raw")).alias("least")), "first")
    texts = written(texts.join(first, "class").select("fa", "fb", F.col("least.rep").alias("class_id"), F.col("least.raw").alias("class_raw")), "classed")
    return sketches.select("id", "raw", "fa", "fb").join(texts, ["fa", "fb"], "left").select("id", "raw", "class_id", "class_raw")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """id and class_id, the smallest id of its class, for every row of ``docs``.

    Null texts are empty; texts without words are copies only of equal texts.
    Rows that share an id but not their text are classed by their texts, each
    on its own. Rows without an id take the class of their copies that have
    one, else null. Repeated rows stay;
    other columns aren't read; an empty table gives an empty one.
    """
    return _classed(docs, id_col, text_col, similar).select(F.col("id").alias(id_col), "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of each class of near duplicates: one with the smallest id, and with the class's text of that id.

    Rows are told apart by id and text, so of repeated rows one stays, and of
    rows that share an id each class keeps its own. Rows without an id go if
    their class has an id; else one of each text stays.
    """
    own = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__raw", F.xxhash64(text_or_empty(text_col)))
    classed = written(_classed(docs, id_col, text_col, similar), "rows")
    stay = classed.where((F.col("id") == F.col("class_id")) & (F.col("raw") == F.col("class_raw")) | F.col("class_id").isNull()).select(F.col("id").alias("__kept"), F.col("raw").alias("__text")).distinct()
    kept = own.join(stay.hint("merge"), (F.col("__raw") == F.col("__text")) & F.col("__id").eqNullSafe(F.col("__kept")), "left_semi")
    return kept.dropDuplicates(["__raw", "__id"]).drop("__id", "__raw")
