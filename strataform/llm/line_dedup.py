"""Line deduplication: lines found in many documents lose all their copies.

Lines are exploded and normalised, hashed, the documents of each hash counted,
and lines over the threshold dropped; what stays is put together by position.
Only DataFrame functions are used.

Shuffles: (1) one row for each distinct line of a document, combined before it
moves, to count documents: rows whose id no other row has are counted, those of
ids that repeat are counted once an id; (2) line hashes with positions, without any text,
against the frequent hashes; (3) documents against their dropped positions.
Text moves once. A line that a third of all documents hold makes one large
key in (2) only. Frequent hashes and dropped positions are written before they
are joined, so both joins are of plain tables, whose large keys adaptive
execution splits; and a lost executor doesn't count lines anew. Lines are told
apart by 128 bits of hash, which aren't confirmed on the strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataform.llm.common import fresh, lower_ascii, text_or_empty, written

#: The characters stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line as it is compared: blanks stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _hash(key: Column) -> Column:
    """128 bits, so that distinct lines of a very large corpus don't meet."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    Returns the columns of ``docs`` with the text replaced by its kept lines,
    and ``n_lines`` (before dropping) and ``n_dropped``.

    Null or empty text: one empty line, kept, as keys shorter than
    ``min_chars`` code points are never dropped; the text comes back empty.
    Rows with the same id are one document: a line counts once for all of them,
    and repeated rows come back as often. Rows without an id count for no line,
    but lose frequent lines like others. Input columns named like the two
    counts are replaced; other columns pass through. An empty table gives an
    empty table.
    """
    base = fresh(docs, "n_lines", "n_dropped")
    order = base.columns
    lines = F.split(text_or_empty(text_col), "\n")
    own = base.select(F.col(id_col).alias("__id"), F.xxhash64(text_or_empty(text_col)).alias("__fp"), F.transform(lines, line_key).alias("__keys"))

    def long_enough(key: Column) -> Column:
        return F.length(key) >= min_chars

    hashes = F.array_distinct(F.transform(F.filter("__keys", long_enough), _hash))
    repeated = base.groupBy(F.col(id_col).alias("__again")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1 AND __again IS NOT NULL").select("__again")
    counted = own.where("__id IS NOT NULL").join(written(repeated, "repeated"), F.col("__id") == F.col("__again"), "left")
    counted = counted.select(F.explode(hashes).alias("h"), "__again").groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b"), "__again").agg(F.count(F.lit(1)).alias("n"))
    documents = F.sum(F.when(F.col("__again").isNull(), F.col("n")).otherwise(1))
    frequent = counted.groupBy("a", "b").agg(documents.alias("n")).where(F.col("n") >= min_docs).select("a", "b")
    # the outer form: a plain one makes Spark compute the keys once more, to filter empty arrays
    placed = own.select("__id", "__fp", F.posexplode_outer("__keys").alias("__pos", "__key")).where(long_enough(F.col("__key")))
    placed = placed.select("__id", "__fp", "__pos", _hash(F.col("__key")).alias("h")).select("__id", "__fp", "__pos", "h.a", "h.b")
    gone = placed.join(written(frequent, "frequent"), ["a", "b"], "left_semi").groupBy("__id", "__fp").agg(F.collect_set("__pos").alias("__gone"))
    gone = written(gone.select(F.col("__id").alias("__gid"), F.col("__fp").alias("__gfp"), "__gone"), "gone")

    held = base.withColumn("__fp", F.xxhash64(text_or_empty(text_col))).join(gone, (F.col(id_col).eqNullSafe(F.col("__gid"))) & (F.col("__fp") == F.col("__gfp")), "left")
    held = held.withColumn("__lines", lines).withColumn("n_lines", F.size("__lines").cast("long"))
    held = held.withColumn("n_dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("__lines"), i)), "\n")
    text = F.when(F.col("__gone").isNull(), text_or_empty(text_col)).otherwise(kept)
    return held.withColumn(text_col, text).select(*order, "n_lines", "n_dropped")
