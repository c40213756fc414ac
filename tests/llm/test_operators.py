"""The ten operators against SQL, brute force, round trips or held-out accuracy, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from strataform.llm import near_dups, packing, queries, tiff, warc

SMALL = "doc_id long, text string, lang string, n_lines long, score double, class_id long"
WORDS = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]


def prose(seed: int, n: int) -> list[str]:
    return random.Random(seed).choices(WORDS, k=n)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty text, repeated rows, a long text, and columns with the names of results."""
    long = " ".join(prose(1, 30_000))
    rows = [(1, None), (2, ""), (3, "a line\nshared"), (3, "a line\nshared"), (None, "no id here"), (4, long), (5, "!!! ..."), (6, "Straße — naïve")]
    return spark.createDataFrame([(i, t, None, 7, 0.5, 9) for i, t in rows], SMALL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SMALL)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), sf_dir, queries.oracle_sql()[name])


# --- 1: TIFF


@pytest.mark.parametrize("scheme", [(c, p, t) for c in (1, 5, 8, 32773) for p in (1, 2) for t in (False, True)])
def test_tiff_round_trip(scheme):
    draw = random.Random(5)
    for rows in (1, 15, 16, 17, 70):
        for data in (bytes(draw.randrange(256) for _ in range(rows * 192)), b"\0" * rows * 192, b"ab" * (rows * 96)):
            pages = list(tiff.decode_tiff(tiff.encode_tiff(data, page_rows=32, schemes=[scheme])))
            assert b"".join(p["samples"] for p in pages) == data
            assert [p["page"] for p in pages] == list(range(-(-rows // 32)))


def test_lzw_over_a_full_table():
    data = bytes(random.Random(2).randrange(256) for _ in range(50_000))
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_tiff_report_of_odd_rows(odd, none):
    rows = tiff.media_report(odd).collect()
    assert len(rows) == odd.count() and tiff.media_report(none).count() == 0
    for r, text in zip(sorted(rows, key=lambda r: (r.n_bytes, r.payload_sha256)), sorted(((t or "").encode() for (t,) in odd.select("text").collect()), key=lambda b: (len(b), hashlib.sha256(tiff.pad_payload(b)).hexdigest()))):
        payload = tiff.pad_payload(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_unreadable_files_give_an_error_row(spark):
    files = spark.createDataFrame([(1, 3, bytearray(b"not a tiff")), (2, 0, None)], "row_id long, n_bytes long, media binary")
    assert [(r.row_id, r.n_pages, r.error is not None) for r in tiff.tiff_pages(files).collect()] == [(1, 0, True)]


def test_bad_sizes_and_counts_are_errors():
    import struct

    good = tiff.encode_tiff(b"ab" * 960, schemes=[(8, 1, False)])

    def changed(tag: int, value: int) -> bytes:
        (at,) = struct.unpack_from("<I", good, 4)
        out = bytearray(good)
        for i in range(struct.unpack_from("<H", good, at)[0]):
            if struct.unpack_from("<H", good, at + 2 + 12 * i)[0] == tag:
                struct.pack_into("<I", out, at + 10 + 12 * i, value)
        return bytes(out)

    assert b"".join(p["samples"] for p in tiff.decode_tiff(good)) == b"ab" * 960
    for tag, value in ((256, 0), (257, 0), (257, 4_000_000_000), (277, 0), (278, 0), (278, 1), (256, 65_535)):
        with pytest.raises(tiff.BadTiff):
            list(tiff.decode_tiff(changed(tag, value)))
    for end in range(len(good)):
        with pytest.raises(tiff.BadTiff):
            list(tiff.decode_tiff(good[:end]))


def test_big_endian_pages_are_read():
    import struct

    entries = [(256, 3, 2), (257, 3, 1), (258, 3, 8), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 1), (279, 4, 2)]
    data = b"MM\0*" + struct.pack(">I", 10) + b"\7\x09" + struct.pack(">H", len(entries))
    data += b"".join(struct.pack(">HHI", t, k, 1) + struct.pack(">I" if k == 4 else ">HH", *([v] if k == 4 else [v, 0])) for t, k, v in entries) + struct.pack(">I", 0)
    assert [p["samples"] for p in tiff.decode_tiff(data)] == [b"\7\x09"]


def test_every_scheme_meets_short_texts():
    used = {next(tiff.decode_tiff(tiff.encode_tiff(tiff.pad_payload(f"text {i}".encode()))))["compression"] for i in range(40)}
    assert used == {c for c, _, _ in tiff.SCHEMES}


# --- 2: WARC


@pytest.mark.parametrize("gzip", [False, True])
def test_warc_chunks_carry_running_digests(spark, gzip):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 1000 + "é"), (2, None, None), (None, "u", "\r\n\r\nWARC/1.1")], "page_id long, url string, html string")
    found = warc.read_chunks(warc.write_archives(pages, gzip=gzip), chunk_bytes=256).orderBy("record_id", "chunk").collect()
    for (row_id,), text in zip([(1,), (2,), (None,)], ["x" * 1000 + "é", "", "\r\n\r\nWARC/1.1"]):
        own = [r for r in found if r.row_id == row_id]
        data = b""
        for i, r in enumerate(own):
            data += bytes(r.bytes)
            assert (r.chunk, r.payload_so_far, r.digest_so_far) == (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert data == text.encode() and [r.last for r in own] == [False] * (len(own) - 1) + [True]


def test_warc_heads_of_any_length(spark):
    """A url of 5 MB, repeated rows, and a payload of several segments."""
    url, text = "http://a/" + "x" * 5_000_000, "é" * 400_000
    pages = spark.createDataFrame([(1, url, "a"), (1, url, "a"), (2, "b", text), (None, "c", text)], "page_id long, url string, html string")
    found = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.revisit_records(pages).collect())
    assert found == [(0, 800_000, "revisit", 2), (1, 1, "response", None), (1, 1, "response", None), (2, 800_000, "response", None)]
    assert {len(r.uri) for r in warc.read_chunks(warc.write_archives(pages.where("page_id = 1"))).collect()} == {len(url)}


def test_http_record_without_a_blank_line():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
    data = head % 30 + b"x" * 30 + b"\r\n\r\n" + head % 9 + b"H\r\n\r\nbody\r\n\r\n"
    for step in (1, 7, len(data)):
        reader = warc.ChunkReader("a", 16)
        rows = [r for i in range(0, len(data), step) for r in reader.feed(data[i : i + step])]
        reader.close()
        assert [r[5] for r in rows] == [b"", b"body"]


def test_warc_revisits_of_odd_rows(spark):
    pages = spark.createDataFrame([(5, "a", "same"), (3, "b", "same"), (9, "c", None), (8, "d", "")], "page_id long, url string, html string")
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.revisit_records(pages).collect()}
    assert found == {3: ("response", None), 5: ("revisit", 3), 8: ("response", None), 9: ("revisit", 8)}
    assert warc.revisit_records(pages.limit(0)).count() == 0


# --- 3: quality


def test_quality_beats_chance_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op3_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r.score for r in scored if r.quality == y] for y in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8, auc


def test_quality_of_odd_rows(spark, odd, none):
    from strataform.llm.quality import held_out, score_quality, train

    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, quality int")
    for learn_from in (labels, labels.limit(0), labels.where("quality = 1")):
        model = train(odd, learn_from, ~held_out())
        scores = [r.score for r in score_quality(odd, model).collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
        assert score_quality(none, model).count() == 0


# --- 4: packing


def test_packing_keeps_every_token_once(odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = [r.asDict() for r in packing.pack_documents(odd).collect()]
    wanted = []
    for i, text in odd.select("doc_id", "text").collect():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        wanted += [(i, n, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(wanted, key=key)
    assert packing.pack_documents(none).count() == 0


def test_packing_is_gapless_and_tight(spark):
    rows = [r.asDict() for r in queries.op4_packing(spark, "/root/testdata/sf0.01").collect()]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by) <= 1.02 * -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 2


@pytest.mark.parametrize("seed", range(3))
def test_plan_uses_every_piece_once(seed):
    lengths = np.random.default_rng(seed).integers(1, 101, 500)
    counts = np.bincount(lengths, minlength=101)
    used = np.zeros(101, int)
    for chosen, times in packing.make_plan(counts, 100):
        assert sum(chosen) <= 100
        for n in chosen:
            used[n] += times
    assert (used == counts).all()


# --- 5: URL filters


def test_all_keys_equal(monkeypatch, tmp_path):
    """With a hash that makes all keys collide, verdicts are those of the strings."""
    from strataform.llm import url_filter

    urls = [("a.example.com", "/en/x"), ("www.example.com", "/en/"), ("com", "/"), ("a.net", "/fr/"), ("net", "/e"), ("x.org", "/en/"), ("a" * 5000 + ".net", "/es/" + "b" * 5000)] * 2
    usual = []
    for same in (False, True):
        if same:
            monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda text: 7)
        path = tmp_path / f"index{same}"
        path.write_bytes(url_filter.build_index(url_filter.RULES))
        usual.append(url_filter.DigestArray(str(path)).judge([h for h, _ in urls], [p for _, p in urls]))
    assert usual[0] == usual[1] and usual[0][:7] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("com/", "allow"), ("net/fr/", "block"), (None, None), (None, None), ("net/es/", "block")]


def test_urls_of_odd_rows(spark):
    from strataform.llm import url_filter

    index = url_filter.build_index(url_filter.RULES)
    assert index
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/x?y"), (4, "x://www.example.com/en/"), (5, "x://com"), (6, "x://a.net/fr/")], "page_id long, url string")
    found = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert found == {1: ("", None, "allow"), 2: ("", None, "allow"), 3: ("a.example.com", "example.com/en/", "block"), 4: ("www.example.com", "www.example.com/en/", "allow"), 5: ("com", None, "allow"), 6: ("a.net", "net/fr/", "block")}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules=[], default="block").collect()} == {"block"}
    again = pages.union(pages.where("page_id = 3")).selectExpr("page_id", "url", "'own' AS host", "'own' AS Verdict", "1 AS n")
    rows = url_filter.filter_urls(again).collect()
    assert len(rows) == 7 and rows[0].n == 1 and sum(r.host == "a.example.com" for r in rows) == 2 and url_filter.filter_urls(again).columns == ["page_id", "url", "n", "host", "path", "rule", "verdict"]


# --- 6: decontamination


def test_leaks_are_found_and_clean_texts_are_not(spark):
    from strataform.llm.decontaminate import drop_leaks, find_leaks

    items = [(i, " ".join(prose(100 + i, 30)) + ". " + " ".join(prose(200 + i, 4)) + ".") for i in range(6)]
    docs = [(i, " ".join(prose(i, 150))) for i in range(40)]
    docs += [(100 + i, " ".join(prose(300 + i, 80)) + " " + t.upper() + " " + " ".join(prose(400 + i, 80))) for i, t in items]
    changed = items[0][1].split()
    changed[3], changed[15] = "other", "words"
    docs += [(200, " ".join(changed)), (201, None), (202, ""), (None, "x")]
    benchmark = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(table, benchmark).collect()}
    assert found == {(100 + i, i) for i, _ in items} | {(200, 0)}
    kept = {r.doc_id for r in drop_leaks(table, benchmark).collect()}
    assert kept == set(range(40)) | {201, 202, None}
    assert find_leaks(table.limit(0), benchmark).count() == find_leaks(table, benchmark.limit(0)).count() == 0


def subsequence(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_leaks_match_brute_force_beside_a_hot_text(spark):
    """More documents than any sample, a third with one long text; short items of common words amid rare ones."""
    from strataform.llm.decontaminate import COPY, find_leaks

    draw = random.Random(6)
    rare = [f"{a}{b}" for a in WORDS for b in WORDS[:12]]
    hot = [f"hot{i}" for i in range(600)]
    items = [(i, draw.choices(WORDS, k=8 + 2 * i)) for i in range(20)]
    docs = []
    for i in range(900):
        words = draw.choices(rare, k=60)
        if i % 3 == 0:
            words += hot
        elif i % 9 == 1:
            own = list(items[i // 9 % 20][1])
            for _ in range(i // 180 % 2):  # a word of half of them is another
                own[draw.randrange(len(own))] = "other"
            at = draw.randrange(60)
            words[at:at] = own
        docs.append((i, words))
    wanted = set()
    for i, words in docs:
        for j, item in items:
            own = set(item)
            if sum(w in own for w in words) >= COPY * len(item) and subsequence(item, words) >= COPY * len(item):
                wanted.add((i, j))
    assert len(wanted) >= 100
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame([(j, " ".join(w)) for j, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(table, benchmark).collect()}
    assert len(found & wanted) / len(wanted) == 1.0
    assert found == wanted


def test_equal_items_are_searched_once(spark, monkeypatch):
    """In blocks of cosines, and with more items than the basis spans."""
    from strataform.llm import decontaminate

    sizes, search = [], decontaminate._search
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(decontaminate, "ITEM_RANK", 4)
    monkeypatch.setattr(decontaminate, "_search", lambda table, items, *rest: (sizes.append(len(items)), search(table, items, *rest))[1])
    texts = [" ".join(prose(700 + i, 20)) for i in range(7)]
    benchmark = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[0])] * 2, "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(prose(i, 30)) + " " + t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id or 0) for r in decontaminate.find_leaks(docs, benchmark).collect())
    assert found == sorted([(i, 0) for i in range(7)] + [(0, 1)] * 2)
    assert sizes == [7]


def test_many_items_take_one_pass(spark):
    """2,000 items, with a third of their words changed in half of the copies."""
    from strataform.llm.decontaminate import find_leaks

    draw, wanted, docs = random.Random(12), set(), []
    items = [(i, prose(5000 + i, 40)) for i in range(2000)]
    for i, own in items[::10]:
        own = list(own)
        if i % 20:
            for k in draw.sample(range(len(own) - 8), 10):
                own[k] = draw.choice(WORDS)
        docs.append((i, prose(9000 + i, 60) + own + prose(20_000 + i, 60)))
        wanted.add((i, i))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w[:-6]) + ". " + " ".join(w[-6:])) for i, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(table, benchmark).collect()}
    assert found <= wanted and len(found) >= 0.9 * len(wanted)


def test_items_with_one_head_in_several_passes(spark, monkeypatch):
    """Bounded passes, blocks and places at once change no row, though all items and texts share their first words."""
    from strataform.llm import decontaminate

    head = prose(1, 12)
    items = [(i, head + prose(5000 + i, 24)) for i in range(150)]
    docs = [(i, (head + prose(40_000 + i, 30)) * 3 + items[i][1] + prose(20_000 + i, 30)) for i in range(0, 150, 5)]
    docs += [(1000 + i, (head + prose(60_000 + i, 9)) * 20) for i in range(20)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")

    def found():
        rows = decontaminate.find_leaks(table, benchmark).collect()
        return sorted((r.doc_id, r.item_id, round(r.lcs_share, 9), round(r.answer_share, 9), r.kind) for r in rows)

    sizes, search = [], decontaminate._search
    once = found()
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 40)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 16)
    monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", 50)
    monkeypatch.setattr(decontaminate, "_search", lambda table, items, *rest: (sizes.append(len(items)), search(table, items, *rest))[1])
    assert found() == once and len(sizes) == 4 and sum(sizes) == 150
    assert {(d, i) for d, i, *_ in once} == {(i, i) for i in range(0, 150, 5)}


def test_leak_recall_on_a_whole_table(spark):
    """Against a subsequence search of every document of sf0.01 for every item."""
    from strataform.llm.decontaminate import COPY, common_words, find_leaks, places

    sf = "/root/testdata/sf0.01"
    docs, benchmark = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "benchmark"))
    hashed = F.transform(near_dups.words_of(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("w")
    items = [(r.item_id, np.array(r.w)) for r in benchmark.select("item_id", hashed).collect()]
    wanted = set()
    for r in docs.select("doc_id", hashed).collect():
        text = np.array(r.w)
        for j, own in items:
            if not len(own):
                continue
            near = np.flatnonzero(np.isin(text, own))
            # windows of half as many words again, from each word that is the item's
            if len(near) >= COPY * len(own) and any(common_words(places(own), len(own), text[i : i + 3 * len(own) // 2], COPY * len(own)) >= COPY * len(own) for i in near.tolist()):
                wanted.add((r.doc_id, j))
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect()}
    assert len(wanted) > 5 and len(found & wanted) >= 0.9 * len(wanted)


@pytest.mark.parametrize("size", [1, 2, 5, 8, 10, 15, 20, 59])
def test_changed_copies_share_a_word_run(size):
    from strataform.llm.decontaminate import COPY, run_length

    draw = random.Random(size)
    for _ in range(200):
        lost = set(draw.sample(range(size), size - -(-int(COPY * size * 10) // 10)))
        runs = "".join(" " if i in lost else "x" for i in range(size)).split()
        assert max(map(len, runs)) >= run_length(size)


def test_copies_are_found_without_the_cosine(spark):
    """Word runs alone find every short copy, one with another word in its place too."""
    from strataform.llm.decontaminate import find_leaks

    items = [(i, prose(800 + i, 10)) for i in range(5)]
    changed = [w if k != 5 else "other" for k, w in enumerate(items[0][1])]
    docs = [(i, [f"rare{i}x{k}" for k in range(70)] + own) for i, own in [*items, (9, changed)]]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(table, benchmark, cosine=2.0).collect()} == {(i, i) for i in range(5)} | {(9, 0)}


# --- 7: licenses


def test_licenses_of_odd_rows(odd, none):
    from strataform.llm.license_scan import license_report

    assert license_report(odd).count() == odd.count() and license_report(none).count() == 0


def test_licenses_with_a_changed_word(spark):
    """Notices with a word put in, left out or replaced in the middle keep their label; strangers have none."""
    from strataform.llm.license_scan import TEMPLATES, license_report

    rows, wanted = [], {}
    for i, (text, label) in enumerate(TEMPLATES):
        words = text.split()
        k = len(words) // 2
        changes = [words, [*words[:k], "odd", *words[k:]], words[:k] + words[k + 1 :], [*words[:k], "odd", *words[k + 1 :]]]
        for own in changes:
            wanted[len(rows)] = label
            rows.append((len(rows), " ".join(prose(i, 20) + own + prose(i + 50, 20))))
    rows += [(1000 + i, " ".join(prose(600 + i, 60))) for i in range(5)]
    for i, (text, _) in enumerate(TEMPLATES):  # four strangers after every five words, or the words in another order
        words = text.split()
        rows.append((2000 + i, " ".join(w for j in range(0, len(words), 5) for w in [*words[j : j + 5], *prose(i + j, 4)]) if len(words) > 14 else " ".join(words[::-1])))
    rows += [(3000, "all rights reserved worldwide " * 3), (3001, "all rights reserved")]
    got = {r.doc_id: r.labels for r in license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i].split(",") for i, label in wanted.items())
    assert all(got[1000 + i] == "" for i in range(5)) and all(got[2000 + i] == "" for i in range(10)), [got[2000 + i] for i in range(10)]
    assert got[3000] == got[3001] == "proprietary"


def test_license_spans_and_their_places(spark):
    from strataform.llm.license_scan import TEMPLATES, license_spans

    texts = ["x y " + TEMPLATES[0][0] + " z", "x " + TEMPLATES[3][0].replace("the ", "the odd ") + " and " + TEMPLATES[3][0], None, "mit license"]
    found = sorted((r.doc_id, r.label, r.first_word, r.last_word, round(r.covered, 3)) for r in license_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert found == [(0, "apache", 2, 9, 1.0), (0, "apache", 5, 6, 1.0), (1, "mit", 1, 6, 1.0), (1, "mit", 5, 6, 1.0), (1, "mit", 8, 12, 1.0), (1, "mit", 11, 12, 1.0), (3, "mit", 0, 1, 1.0)]
    with pytest.raises(ValueError):
        license_spans(spark.createDataFrame([], "doc_id long, text string"), phrases=[("mit", "mit")])


def test_licenses_with_many_templates_take_a_join(spark, sf_dir, monkeypatch):
    """Above the bound of the broadcast the rows are the same."""
    from strataform.llm import license_scan

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    usual = sorted(map(str, license_scan.license_report(docs).collect()))
    monkeypatch.setattr(license_scan, "BROADCAST_GRAMS", 0)
    assert sorted(map(str, license_scan.license_report(docs).collect())) == usual


# --- 8: language ID


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9


def test_languages_of_odd_rows(odd, none):
    from strataform.llm.language_id import identify_languages

    assert {r.lang_pred for r in identify_languages(odd).collect()} == {"und"}
    assert identify_languages(none).count() == 0


# --- 9: line dedup


def test_lines_of_odd_rows(spark, odd, none):
    from strataform.llm.line_dedup import drop_repeated_lines

    assert drop_repeated_lines(odd).count() == odd.count() and drop_repeated_lines(none).count() == 0
    kept = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(odd).collect())
    assert kept == sorted((i or 0, t or "", (t or "").count("\n") + 1, 0) for i, t in odd.select("doc_id", "text").collect())
    docs = spark.createDataFrame([(i, f" Common \nown {i}\n\ncommon") for i in range(10)], "doc_id long, text string")
    assert {(r.text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(docs).collect()} == {(f"own {i}\n", 4, 2) for i in range(10)}
    assert {r.n_dropped for r in drop_repeated_lines(docs.limit(9)).collect()} == {0}


def test_lines_count_documents_not_rows(spark, tmp_path):
    """Rows of one id are one document, rows without an id none; as the SQL has it."""
    from strataform.llm.line_dedup import drop_repeated_lines

    rows = [(1, "x")] * 10 + [(i, "y") for i in range(9)] + [(None, "y")] * 3 + [(i, "z\nz") for i in (1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.text, r.n_dropped) for r in drop_repeated_lines(docs).collect()}
    assert (1, "x", 0) in found and (0, "y", 0) in found and (10, "", 2) in found and not any(t.startswith("z") for _, t, _ in found)


# --- 10: near duplicates


def brute_classes(docs, idf) -> dict[int, int]:
    rows = docs.select("doc_id", F.transform(near_dups.words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).collect()
    sets = {r.doc_id: near_dups.shingles(np.array(r.h, np.int64), idf) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if near_dups.weighted_jaccard(sets[a], sets[b]) >= near_dups.SIMILAR:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    draw, rows = random.Random(3), []
    passage = prose(50, 120)
    for i in range(30):
        rows.append(prose(1000 + i, 150))
        rows.append(passage + prose(2000 + i, 30))  # a common passage, about 0.67 alike
    base = prose(60, 200)
    for i in range(40):  # a chain of copies that drift apart
        base = list(base)
        base[draw.randrange(200)] = draw.choice(WORDS)
        rows.append(base)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    assert got == brute_classes(docs, near_dups.document_frequencies(docs))


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_dups.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and near_dups.near_duplicates(none).count() == 0
    found = {r.doc_id: r.class_id for r in rows}
    assert found[1] == found[2] == 1 and found[3] == 3 and found[4] == 4


def test_near_duplicates_of_shared_ids(spark):
    """Rows are classed by their texts, whatever ids they share."""
    p, q = prose(70, 60), prose(71, 60)
    rows = [(3, p), (5, [*p, "tail"]), (5, q), (7, [*q, "other"]), (7, [*q, "other"]), (None, p)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.class_id) for r in near_dups.near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (5, 3), (5, 5), (7, 5), (7, 5)]


def test_near_duplicates_of_small_blocks_match_brute_force(spark, monkeypatch):
    """Many texts with one passage, some in classes that their bucket's leader isn't in, compared over many blocks."""
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    draw, rows = random.Random(8), []
    passage = prose(80, 150)
    for i in range(40):
        own = passage + prose(3000 + i, 35)
        rows += [own, [*own[:-3], *draw.choices(WORDS, k=3)]]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    wanted = brute_classes(docs, near_dups.document_frequencies(docs))
    assert 10 < len(set(wanted.values())) <= 41
    assert got == wanted


def test_texts_that_share_a_passage_only_are_not_compared(spark, monkeypatch):
    """A mixed bucket of n texts with one passage: none of them enters a block, pairs among them do and are found."""
    monkeypatch.setattr(near_dups, "BLOCK", 32)
    passage = prose(1, 120)
    pools = {}
    for n in (200, 400):
        texts = [" ".join(passage + prose(100 + i, 45)) for i in range(n)]
        texts += [t + " and one more" for t in texts[:10]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        sizes = []
        monkeypatch.setattr(near_dups, "families", lambda feats, similar, made=near_dups.families: (f := made(feats, similar), sizes.append((feats.count(), f.count())))[0])
        found = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
        monkeypatch.undo()
        monkeypatch.setattr(near_dups, "BLOCK", 32)
        assert found == {i: i - n if i >= n else i for i in range(n + 10)}
        pools[n] = sizes
    assert all(after <= 20 < before for sizes in pools.values() for before, after in sizes) and pools[400]


def test_keep_one_goes_by_text(spark):
    p, q, r = (" ".join(prose(i, 60)) for i in (1, 2, 3))
    rows = [(3, p), (5, p + " tail"), (5, q), (9, r), (9, r), (None, r), (None, "a text of its own"), (None, "a text of its own"), (11, None), (12, "")]
    kept = near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((k.doc_id or 0, k.text) for k in kept), key=str) == sorted([(3, p), (5, q), (9, r), (0, "a text of its own"), (11, None)], key=str)


def test_near_duplicate_recall_on_a_whole_table(spark):
    """Against all pairs of sf0.01: the links whose ends share a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    wanted = brute_classes(docs, near_dups.document_frequencies(docs))
    linked = [i for i, c in wanted.items() if i != c]
    assert len(linked) > 20
    assert np.mean([got[i] == got[wanted[i]] for i in linked]) >= 0.9
    # and no two documents of different classes share one
    assert all(wanted[i] == wanted[c] for i, c in got.items())


# --- the pipeline


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    """Nulls, shared ids, repeated rows and clashing columns go through all stages; an empty table gives an empty one."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose(77, 40)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = spark.createDataFrame([(21, "Before. " + " ".join(prose(77, 40)), None, 7, 0.5, 9), (21, " ".join(prose(78, 60)), None, 7, 0.5, 9)], SMALL)
    for name, docs in (("odd", odd.union(leak)), ("none", none)):
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns, stage_name
            docs = spark.createDataFrame(after.collect(), docs.schema)
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert (len(rows) > 0) == (name == "odd")
        if name == "odd":
            kept = docs.collect()
            assert len({(k.doc_id, k.text) for k in kept}) == len(kept)
            assert [k.text for k in kept if k.doc_id == 21] == [" ".join(prose(78, 60))]
            assert [k.doc_id for k in kept].count(3) == 1 and [k.doc_id for k in kept].count(None) == 1


def test_pipeline_packs_what_its_stages_keep(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir).cache()
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}
        kept = after
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    spark.catalog.clearCache()
