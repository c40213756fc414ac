"""License scans by diagonal voting.

Every rolling word k-gram of every document is hashed and joined with the
template positions of that hash. A hit at document word i and template word j
votes for the diagonal i - j of its document and template. A diagonal is merged
with those at most ``SLACK`` to its right, so that a few inserted or missing
words don't break a span, but no more of them, and spans are verified by the
share of their template that they cover. Long templates have grams of five
words; short ones pairs of words next to each other or with one between, so
that a word put in, left out or replaced costs them no more than that word.
Every hit is confirmed on the words themselves, so hash collisions don't count.
Only DataFrame functions are used.

Templates are a fixed, small list, so their positions are broadcast; a caller's
own list is broadcast only up to ``BROADCAST_GRAMS`` positions and else joined
by shuffle. Only hits and one marker row for each document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataform.llm.common import fresh, lower_ascii, text_or_empty

BROADCAST_GRAMS = 100_000
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words of the grams of phrases and short templates, and of longer templates; words from which on a template is long.
PHRASE_K, TEMPLATE_K, LONG = 2, 5, 11
#: Diagonals this close are one span.
SLACK = 4

#: Phrases whose places are counted, and their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
#: Sentences of public licenses, and their labels.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("all rights reserved worldwide", "proprietary"),
]
_MARK = -1


def words_of(text: Column) -> Column:
    """Runs of digits, ASCII letters (lower-cased) and non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(text), BREAK), "")


def _pairs(words: Column, hashed: Column, gap: int) -> Column:
    """Hashes of all words with the one ``gap`` places on; how far it is isn't part of the hash."""
    n = F.size(words) - gap - 1
    rolled = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.lit(PHRASE_K), F.get(hashed, i), F.get(hashed, i + gap)))
    return F.when(n >= 0, rolled).otherwise(F.array().cast("array<bigint>"))


def _grams(words: Column, hashed: Column) -> Column:
    """Hashes of all runs of TEMPLATE_K words."""
    n = F.size(words) - TEMPLATE_K
    rolled = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.lit(TEMPLATE_K), *[F.get(hashed, i + j) for j in range(TEMPLATE_K)]))
    return F.when(n >= 0, rolled).otherwise(F.array().cast("array<bigint>"))


TEMPLATE = "t_id int, t_label string, t_exact boolean, t_words int, t_pos int, t_hash bigint, t_gram array<string>, t_covers array<int>"


def _template_grams(docs: DataFrame, phrases: list, templates: list) -> tuple[DataFrame, int]:
    """A row for each gram of each phrase and template: its place, words and the words of the template that it covers."""
    rows = []
    for i, (text, label, exact) in enumerate([*((t, x, True) for t, x in phrases), *((t, x, False) for t, x in templates)]):
        words = text.split()
        if len(words) < PHRASE_K:
            raise ValueError(f"a phrase or template of one word can't be found: {text}")
        if exact or len(words) < LONG:
            places = [[p, p + gap] for gap in ((1,) if exact else (1, 2)) for p in range(len(words) - gap)]
        else:
            places = [list(range(p, p + TEMPLATE_K)) for p in range(len(words) - TEMPLATE_K + 1)]
        rows += [(i, label, exact, len(words), covers[0], [words[p] for p in covers], covers) for covers in places]
    t = docs.sparkSession.createDataFrame(rows, TEMPLATE.replace("t_hash bigint, ", ""))
    hashed = F.transform("t_gram", lambda w: F.xxhash64(w))
    one = F.xxhash64(F.lit(PHRASE_K), F.get(hashed, 0), F.get(hashed, 1))
    t = t.withColumn("t_hash", F.when(F.size("t_gram") == PHRASE_K, one).otherwise(F.xxhash64(F.lit(TEMPLATE_K), *[F.get(hashed, j) for j in range(TEMPLATE_K)])))
    return t, len(rows)


def _diagonals(docs: DataFrame, id_col: str, text_col: str, phrases: list, templates: list) -> DataFrame:
    """A row for each document, template and diagonal with votes, and a marker row (t_id -1) for each document."""
    own = docs.select(F.col(id_col).alias("d_id"), text_or_empty(text_col).alias("__text"))
    own = own.select("d_id", F.xxhash64("__text").alias("d_fp"), words_of(F.col("__text")).alias("words"))
    own = own.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words"))
    next_ones, second_ones = (_pairs(F.col("words"), F.col("hashed"), gap) for gap in (1, 2))
    own = own.select("d_id", "d_fp", "words", "n_words", F.concat(F.array(F.lit(0).cast("bigint")), next_ones, second_ones, _grams(F.col("words"), F.col("hashed"))).alias("grams"))
    # the outer form: a plain explode of a column makes Spark compute the grams once more, to filter empty arrays
    rolled = own.select("d_id", "d_fp", "n_words", "words", F.posexplode_outer("grams").alias("p", "h"))

    t, n_grams = _template_grams(docs, phrases, templates)
    mark = docs.sparkSession.createDataFrame([(_MARK, "", False, 1, 0, 0, [], [])], TEMPLATE)
    t = t.select(mark.columns).unionByName(mark)
    # the first element of a document's grams is its marker; then the pairs of either distance, then the long grams
    n_next, n_second = (F.greatest(F.col("n_words") - gap, F.lit(0)) for gap in (1, 2))
    p = F.col("p")
    gap = F.when(p <= n_next, 1).when(p <= n_next + n_second, 2).otherwise(0)
    start = p - 1 - F.when(gap == 1, 0).when(gap == 2, n_next).otherwise(n_next + n_second)
    gram = F.when(gap > 0, F.array(F.get("words", start), F.get("words", start + gap))).otherwise(F.slice("words", start + 1, TEMPLATE_K))
    if n_grams <= BROADCAST_GRAMS:
        t = F.broadcast(t)
    else:
        # the grams are shuffled: each with its own words, not with all of its document
        rolled = rolled.withColumn("gram", F.when(p > 0, gram)).drop("words")
        gram = F.col("gram")
    hits = rolled.join(t, rolled.h == t.t_hash)
    own_mark = (p == 0) & (F.col("t_id") == _MARK)
    same = (p > 0) & (F.col("t_id") != _MARK) & (gram == F.col("t_gram")) & (~F.col("t_exact") | (gap == 1))
    hits = hits.where(own_mark | same).select("d_id", "d_fp", "n_words", "t_id", "t_label", "t_exact", "t_words", "t_pos", "t_covers", F.when(p == 0, 0).otherwise(start).alias("start"), F.when(gap > 0, gap).otherwise(TEMPLATE_K - 1).alias("reach"))
    return (
        hits.withColumn("diagonal", F.col("start") - F.col("t_pos"))
        .groupBy("d_id", "d_fp", "n_words", "t_id", "t_label", "t_exact", "t_words", "diagonal")
        .agg(F.count(F.lit(1)).alias("rows"), F.array_distinct(F.flatten(F.collect_set("t_covers"))).alias("seen"), F.min("start").alias("first"), F.max(F.col("start") + F.col("reach")).alias("last"))
    )


def _spans(diagonals: DataFrame, coverage: float) -> DataFrame:
    """Each diagonal with its neighbours to the right, kept if they hold enough of the template's words; marker rows pass.

    Phrases are exact: a diagonal stands alone and must hold all. Of a template
    one word may always be missing.
    """
    by = Window.partitionBy("d_id", "d_fp", "n_words", "t_id").orderBy("diagonal")
    near = by.rangeBetween(0, SLACK)
    exact = F.col("t_exact")
    merged = diagonals.select(
        "d_id", "d_fp", "n_words", "t_id", "t_label", "t_exact", "t_words", "diagonal", "rows",
        F.when(exact, F.col("seen")).otherwise(F.array_distinct(F.flatten(F.collect_list("seen").over(near)))).alias("seen"),
        F.when(exact, F.col("first")).otherwise(F.min("first").over(near)).alias("first"), F.when(exact, F.col("last")).otherwise(F.max("last").over(near)).alias("last"),
    )
    held = merged.withColumn("held", F.size("seen")).withColumn("covered", F.size("seen") / F.col("t_words")).drop("seen")
    enough = F.when(exact, F.col("held") == F.col("t_words")).otherwise(F.col("held") >= F.least(F.ceil(F.col("t_words") * coverage), F.col("t_words") - 1))
    return held.where((F.col("t_id") == _MARK) | enough)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list = PHRASES, templates: list = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """One row for each verified span: id, label, first_word, last_word, covered (0 to 1).

    Of spans of one template whose diagonals are near, the first of the best is
    reported. Null and empty texts have no spans. Repeated rows give their spans
    once. Phrases and templates have two words or more.
    """
    found = _spans(_diagonals(docs, id_col, text_col, phrases, templates), coverage).where(F.col("t_id") != _MARK)
    by = Window.partitionBy("d_id", "d_fp", "n_words", "t_id").orderBy("diagonal")
    before, after = (F.coalesce(F.max("held").over(by.rangeBetween(*r)), F.lit(0)) for r in ((-SLACK, -1), (1, SLACK)))
    found = found.withColumn("best", F.col("t_exact") | ((F.col("held") > before) & (F.col("held") >= after))).where("best")
    return found.select(
        F.col("d_id").alias(id_col), F.col("t_label").alias("label"), F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("last_word"), F.least(F.col("covered"), F.lit(1.0)).alias("covered")
    )


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list = PHRASES, templates: list = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """One row for each document: n_words, places of the phrases, labels and score.

    n_base counts the places of the phrases, first_word and last_word are their
    smallest and largest start, base_labels their labels; labels has those of
    the verified template spans too; score is the best coverage of any of them,
    0 without one. Null or empty text: no words, no labels, score 0. Repeated
    rows come back as often as they stand in ``docs``; rows of one id with
    different texts are reported apart. Null ids pass through. Other columns of
    ``docs``, whatever their names, aren't read. A phrase or template of one word
    is refused.
    """
    found = _spans(_diagonals(fresh(docs), id_col, text_col, phrases, templates), coverage)
    base = F.col("t_exact")
    real = F.col("t_id") != _MARK
    report = found.groupBy("d_id", "d_fp", "n_words").agg(
        F.max(F.when(~real, F.col("rows"))).alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("t_label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(real, F.col("t_label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(real, F.least(F.col("covered"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
    )
    report = report.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return report.select(F.col("d_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
