"""Spelling variants: words one edit apart, found by pairs of trie nodes.

Every prefix of a word is a node of the trie of words, every suffix a node of
the trie of reversed words, both numbered by integers. A word with one code
point skipped is the pair (node before, node after), a place between two code
points likewise. Two words differ by one replaced code point if they share a
pair of skips, and by one inserted or deleted if a skip of the longer is a
place of the shorter. Equal pairs of integers are equal strings, so all
neighbours are found and nothing else, and no strings are compared.

Nodes down to nine code points are numbered by packing them, seven bits each;
deeper ones by counting in a task that has all words with the same nine first
code points, sorted: a word's new nodes are those below what it shares with
the word before.

Within a pair there is at most one skip for each letter of the alphabet and
one place, which bounds a group by ``len(LETTERS) + 1`` rows whatever the
corpus. A longer word that repeats the skipped code point has several skips
that give the same shorter word; only the first of a repetition is joined with
places, so no two words meet twice and counts are sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from strataform.llm.common import lower_ascii, text_or_empty, written

#: What a word is made of, after A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
PACKED, BITS = 9, 7
MIN_LENGTH, MIN_COUNT, RATIO, DAMAGE = 6, 5, 5, 199


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """word and n: the lower-cased letter runs of all texts with at least so many code points and occurrences.

    With ``damage``, a run whose checksum with its document's id is divisible by
    it loses one code point, so that the grouping has something to find.
    Occurrences are added up before they move.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(text_or_empty(text_col)), F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if damage:
        runs = runs.where(F.length("run") >= min_length).withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
        word = F.when(F.col("h") % damage == 0, cut).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node ids of every prefix of the last column's strings, which are sorted."""
    code = {letter: i + 1 for i, letter in enumerate(LETTERS)}
    below = -(TaskContext.get().partitionId() << 40) - 1
    word, path, made = "", [0], 0
    for batch in batches:
        found = []
        for now in batch.column(batch.num_columns - 1).to_pylist():
            shared = 0
            for a, b in zip(word, now):
                if a != b:
                    break
                shared += 1
            path = path[: shared + 1]
            for depth in range(shared, len(now)):
                if depth < PACKED:
                    path.append(path[-1] << BITS | code[now[depth]])
                else:
                    path.append(below - made)
                    made += 1
            word = now
            found.append(path)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "nodes"])


def trie_nodes(words: DataFrame) -> DataFrame:
    """word, n, and the nodes of its prefixes and of its suffixes, by length from 0.

    Words are distinct and made of ``LETTERS``; any other letter is an error.
    """

    def numbered(df: DataFrame, key: Column, name: str) -> DataFrame:
        """One shuffle by the first code points; deeper nodes are numbered within them."""
        schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), "nodes array<long>"])
        keyed = df.withColumn("key", key).repartition(F.substring("key", 1, PACKED)).sortWithinPartitions("key")
        return keyed.mapInArrow(_number, schema).withColumnRenamed("nodes", name)

    forward = numbered(words.select("word", "n"), F.col("word"), "prefixes")
    return written(numbered(forward, F.reverse("word"), "suffixes"), "trie-nodes")


def near_words(words: DataFrame) -> DataFrame:
    """For each word with near words: word, n_near (how many), best (struct of minus_n and word: the most frequent, ties the least)."""
    length = F.length("word")

    def letter(i: Column) -> Column:
        return F.substring(F.col("word"), i + 1, F.lit(1))

    def skip(i: Column) -> Column:
        first = (i == 0) | (letter(i) != letter(i - 1))
        return F.struct(F.get("prefixes", i).alias("p"), F.get("suffixes", length - 1 - i).alias("s"), F.lit(True).alias("skips"), first.alias("first"))

    def place(i: Column) -> Column:
        return F.struct(F.get("prefixes", i).alias("p"), F.get("suffixes", length - i).alias("s"), F.lit(False).alias("skips"), F.lit(False).alias("first"))

    spots = F.concat(F.transform(F.sequence(F.lit(0), length - 1), skip), F.transform(F.sequence(F.lit(0), length), place))
    placed = trie_nodes(words).select("word", "n", F.explode(spots).alias("at"))
    groups = placed.groupBy("at.p", "at.s").agg(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "word", "at.skips", "at.first")).alias("members")).where(F.size("members") > 1)

    groups = groups.select(
        F.filter("members", lambda m: ~m["skips"]).alias("short"),
        F.array_sort(F.filter("members", lambda m: m["skips"])).alias("long"),
    ).withColumn("once", F.filter("long", lambda m: m["first"]))

    def named(member: Column) -> Column:
        return F.when(member.isNotNull(), F.struct(member["minus_n"].alias("minus_n"), member["word"].alias("word")))

    def of_long(m: Column) -> Column:
        other = F.when(F.get("long", F.lit(0))["word"] == m["word"], F.get("long", F.lit(1))).otherwise(F.get("long", F.lit(0)))
        short = F.when(m["first"], F.get("short", F.lit(0)))
        n = F.size("long") - 1 + F.when(m["first"], F.size("short")).otherwise(0)
        return F.struct(m["word"].alias("word"), n.alias("n_near"), F.array_min(F.array_compact(F.array(named(other), named(short)))).alias("best"))

    def of_short(m: Column) -> Column:
        return F.struct(m["word"].alias("word"), F.size("once").alias("n_near"), named(F.get("once", F.lit(0))).alias("best"))

    each = groups.select(F.explode(F.concat(F.transform("long", of_long), F.transform("short", of_short))).alias("x")).select("x.*")
    return each.where("n_near > 0").groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root for words with a form: forms followed to the last, twice as far in each round.

    A form is at least RATIO times as frequent, so a chain has at most
    log(largest n) / log(RATIO) links and the rounds are the logarithm of that.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        further = reached.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        further = written(further, "roots")
        reached = further.drop("moved")
        if further.where("moved").isEmpty():
            return reached


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the corpus (see ``count_words``).

    ``form``: the near word of the largest n (ties: the least in code-point
    order) if it is at least ``ratio`` times as frequent, else null; ``root``:
    the last of the chain of forms, or the word itself. ``ratio`` is over 1.

    Null or empty texts have no words; a null id counts as empty in checksums
    only. Repeated rows count again. Other columns are ignored. An empty table
    gives an empty table.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variant")
    words = written(count_words(docs, id_col, text_col, min_length, min_count, damage), "words")
    near = near_words(words).withColumnRenamed("word", "near_of")
    taken = -F.col("best.minus_n") >= F.col("n") * ratio
    found = words.join(near, F.col("word") == F.col("near_of"), "left")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.minus_n")).alias("form_n"))
    found = written(found, "variants")
    roots = _roots(found.where("form IS NOT NULL")).select(F.col("word").alias("rooted"), "root")
    return found.join(roots, F.col("word") == F.col("rooted"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
