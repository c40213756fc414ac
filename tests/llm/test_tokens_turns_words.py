"""Token counts, conversation repair and spelling variants against the library and brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from strataform.llm import conversation_repair as repair, queries, spelling, token_counts
from strataform.llm.packing import default_tokenizer

DOCS = "doc_id long, text string, n_tokens string, word string, n long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "other", "other", 7) for i, t in texts], DOCS)


# --- 11: token counts


def library_counts(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_are_the_librarys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r, n in zip(docs, library_counts([d.text for d in docs])):
        found = got[r.doc_id]
        assert (found.n_bytes, found.n_tokens, found.over_limit) == (len((r.text or "").encode()), n, n > 2048), r.doc_id


def test_token_counts_of_odd_texts(spark):
    draw = random.Random(3)
    letters = "aaaabcdEFGéÉßſİıǅΣς½٣ⅷ中文🙂👩‍👩‍👧́̀'’.,!?-_<|>\t\r\x0b\x85\xa0 　​﻿\x00"
    texts = ["", None, "aaaaaaaaaaa", "it's we'll I'D 'sss", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|> <|ENDOFTEXT|> <|endof text|>", "á éx́ ́b"]
    texts += ["".join(draw.choices(letters, k=draw.randrange(1, 80))) for _ in range(1500)]
    texts += ["".join(draw.choices("abcdefgh", k=6_000)), "ab" * 5_000, "a" * 10_000, "word " * 50_000, "🙂" * 3_000]
    docs = docs_of(spark, [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "again"), (3, "again")])
    found = token_counts.count_tokens(docs, limit=4)
    assert found.columns == ["doc_id", "text", "word", "n", "n_bytes", "n_tokens", "over_limit"]
    rows = found.collect()
    assert len(rows) == len(texts) + 3
    for r, n in zip(rows, library_counts([r.text for r in rows])):
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 4), r.text
    assert token_counts.count_tokens(docs.where("doc_id < 0")).count() == 0


def test_a_pair_made_anew_by_a_later_rank_waits():
    """Two ways to make abc: the places of a pair may not merge together if what they make has an earlier rank."""
    vocab = {s: i for i, s in enumerate(["a", "b", "c", "bc", "abc", "abca"])}
    merges = token_counts.Merges(vocab, ["b c", "abc a", "a bc"], "")
    assert merges.together.tolist() == [True, True, False]

    def one_by_one(word):
        parts, ranks = list(word), {("b", "c"): 0, ("abc", "a"): 1, ("a", "bc"): 2}
        while found := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]:
            _, i = min(found)
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
        return len(parts)

    words = ["".join(w) for n in range(1, 8) for w in itertools.product("abc", repeat=n)]
    assert merges.survivors(*merges.symbols(words)).tolist() == [one_by_one(w) for w in words]


def test_vocabularies_that_keep_white_space_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.WordCounts(public_tokenizers.path("byte_bpe_50k.json"))


# --- 12: conversation repair

CONVERSATIONS = "conv_id long, turn long, role string, text string, audit long"


def cheapest(rows):
    """All edits of a few rows, whole audits compared; rows are (initial, fault)."""
    best = None
    limit = 2 * len(rows)  # deleting all rows always does

    def walk(i, roles, cost, audit, inserted):
        nonlocal best
        if cost > limit or (best and cost > best[0]):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit)) if best else (cost, audit)
        if inserted < 2:
            for role in "ua":
                walk(i, roles + role, cost + 5, audit + "I", inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            walk(i + 1, roles, cost + 2, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                walk(i + 1, roles + initial, cost + more, audit + "K", 0)
                for role in "ua":
                    walk(i + 1, roles + role, cost + 1 + more, audit + "R", 0)

    walk(0, "", 0, "", 0)
    return best


def searched(rows):
    search, out, held = repair.Repair(), [], 0
    for n, (initial, fault) in enumerate(rows):
        out += search.push((n, initial, "text", fault), initial, fault)
        held = max(held, search.held)
    out += search.finish()
    assert search.held == 0
    roles = "".join(role[0] for _, role, _ in out if role)
    assert re.fullmatch("(s?(ua)+)?", roles) and [r[0] for _, _, r in out if r] == list(range(len(rows)))
    cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] + (5 if e in "KR" and r[3] == "truncated" else 0) for e, _, r in out)
    return (cost, "".join(e for e, _, _ in out)), held


def test_repair_against_all_edits_of_short_conversations():
    kinds = [(i, f) for i in "sua " for f in (None, "blank", "truncated")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert searched(rows)[0] == cheapest(rows), rows
    draw = random.Random(1)
    for _ in range(300):
        rows = draw.choices([(i, f) for i in "suuaa " for f in (None, None, None, "blank", "duplicate", "truncated")], k=draw.randrange(4, 8))
        assert searched(rows)[0] == cheapest(rows), rows


def test_repair_holds_only_rows_in_dispute():
    turns = [("ua"[i % 2], None) for i in range(20_000)]
    draw = random.Random(2)
    for i in draw.sample(range(20_000), 2_000):
        turns[i] = draw.choice([("u", "blank"), ("a", "truncated"), ("u", None), ("s", None)])
    found, held = searched(turns)
    assert held < 200
    assert searched([("u", "blank")] * 5_000 + [("u", None), ("a", None)])[1] < 20


def brute_report(rows):
    """The contract's columns for one conversation, from its rows after damage, in order."""
    faults, seen, kinds = Counter(), set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        kinds.append((role[:1] or "?", fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    cost, audit = cheapest(kinds)
    state, at, kept = "", 0, []
    for edit in audit:
        row = rows[at] if edit != "I" else (None, "", "")
        at += edit != "I"
        if edit in "RI":
            state = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            kept.append(f"{ {'u': 'user', 'a': 'assistant'}[state]}:{row[2]}")
        elif edit == "K":
            state = row[1][:1]
            kept.append(f"{row[1]}:{row[2]}")
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def brute_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def check_conversations(df):
    got = {r.conv_id: tuple(r)[1:] for r in repair.damage_report(df).collect()}
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert set(got) == {r[0] for r in rows}
    for conv_id in got:
        own = brute_damage([r for r in rows if r[0] == conv_id])
        assert got[conv_id] == brute_report(own), (conv_id, own)


def test_conversations_against_brute_force(spark, sf_dir):
    check_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def test_odd_conversations(spark):
    draw = random.Random(4)
    texts = ["One.", "Two!", "no end", "", " \n", None, "one.", "A long text. " * 20_000]
    rows = [(c, draw.choice([None, 0, 1, 1, 2, 3, 9]), draw.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), draw.choice(texts), 1) for c in [*range(80), None] for _ in range(draw.randrange(1, 7))]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    check_conversations(df)
    assert repair.damage_report(df.where("conv_id < 0")).count() == 0
    edits = repair.repair_conversations(df.where("conv_id = 3")).collect()
    assert [e.seq for e in edits] == list(range(len(edits)))


# --- 13: spelling variants


def variants(word):
    """What a word becomes when one code point goes, and the places where one may be put in or replaced."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def brute_groups(texts, damage=None, min_length=6, min_count=5, ratio=5):
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return min(a, b, key=len) in variants(max(a, b, key=len))

    rows, forms = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= ratio * n[w] else None
        rows[w] = len(others)
    out = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n[w], rows[w], n[forms[w]] if forms[w] else None))
    return out


def test_variants_of_the_tables_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {tuple(r) for r in queries.op13_spelling_variants(spark, sf_dir).collect()}
    assert got == brute_groups([(r.doc_id, r.text) for r in docs.collect()], 199)


def test_variants_of_odd_words(spark):
    draw = random.Random(6)
    words = ["".join(draw.choices("ab", k=draw.randrange(5, 9))) for _ in range(60)] + ["".join(draw.choices("aé", k=draw.randrange(10, 13))) for _ in range(60)]
    words += ["x" * 300, "x" * 301, "x" * 299 + "y", "Straße", "ÀÉÎÕÜ×÷ÿ", "Mississippi", "Missisippi", "Mississipi"]
    texts = [(draw.randrange(40), " ".join(draw.choices(words, weights=[1 / (i % 17 + 1) ** 2 for i in range(len(words))], k=400))) for _ in range(30)]
    texts += [(5, "alphabet " * 150 + "alphabett " * 25 + "alphabettt " * 5)]
    texts += [(1, None), (2, ""), (None, "Missisippi 12 Missisippi_missisippi"), (3, "\n".join(words)), (3, "\n".join(words))]
    for damage in (None, 7):
        got = {tuple(r) for r in spelling.group_variants(docs_of(spark, texts), damage=damage).collect()}
        want = brute_groups(texts, damage)
        assert got == want and any(form for _, form, *_ in want) and any(form != root for _, form, root, *_ in want if form)
    assert spelling.group_variants(docs_of(spark, [(1, None)])).count() == 0
    assert spelling.group_variants(docs_of(spark, texts).where("doc_id < 0")).count() == 0


def test_members_of_a_node_pair_are_bounded(spark):
    words = spark.createDataFrame([("abcde" + c + "fghijk", 5) for c in spelling.LETTERS] + [("abcdefghijk", 9)], "word string, n long")
    near = {r.word: (r.n_near, r.best.word) for r in spelling.near_words(words).collect()}
    assert near["abcdefghijk"] == (len(spelling.LETTERS), "abcdeafghijk")
    assert near["abcdezfghijk"] == (len(spelling.LETTERS), "abcdefghijk")
