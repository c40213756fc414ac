"""Language ID and the quality score against plain Python, step by step."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strataform.llm import language_id, quality


def plain_vector(text, encoder):
    """The sum over all runs of three signs of their letters' vectors, rolled by place and multiplied."""
    signs, total = [0], np.zeros(encoder.d)
    for c in text.lower():
        if c.isalpha():
            signs.append(ord(c))
        elif signs[-1] != 0:
            signs.append(0)
    signs.append(0)
    if len(signs) > 2 and signs[-2] == 0:
        signs.pop()
    for i in range(len(signs) - 2):
        bound = np.ones(encoder.d)
        for place in range(3):
            bound = bound * np.roll(encoder._symbol(signs[i + place]).astype(float), 2 - place)
        total += bound
    return total


def test_languages_against_plain_python(spark):
    draw = random.Random(2)
    pools = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "der"], "cc": ["éa", "que", "ion", "ou"]}
    rows = []
    for i in range(120):
        lang = draw.choice(sorted(pools))
        rows.append((i, " ".join("".join(draw.choices(pools[lang], k=2)) for _ in range(draw.randrange(1, 12))) + draw.choice(["", ".", "! 12"]), lang if i % 7 else None))
    rows += [(200, None, "aa"), (201, "12 !", "aa"), (None, "kalo mitu", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    encoder = language_id.Encoder()
    sums = {lang: np.zeros(encoder.d) for lang in pools}
    for i, text, lang in rows:
        if lang and text and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            vector = plain_vector(text, encoder)
            if any(c.isalpha() for c in text):
                sums[lang] += vector / np.linalg.norm(vector)
    names = sorted(sums)
    goal = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    for r, (i, text, _) in zip(language_id.identify_languages(docs).collect(), rows):
        assert r.doc_id == i and r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        vector = plain_vector(text, encoder)
        cosines = goal @ (vector / np.linalg.norm(vector))
        weights = [math.exp(language_id.SHARPNESS * (c - cosines.max())) for c in cosines]
        assert r.lang_pred == names[int(cosines.argmax())] and abs(r.score - max(weights) / sum(weights)) < 1e-3


def test_quality_scores_against_plain_python(spark):
    import zstandard

    draw = random.Random(4)
    words = {1: ["the", "order", "of", "words", "is", "calm"], 0: ["x9", "buy", "!!", "zzz", "q7", "now"]}
    rows = [(i, " ".join(draw.choices(words[i % 2], k=draw.randrange(1, 200)))) for i in range(200)] + [(500, None), (501, ""), (502, "calm " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (502, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    packers = []
    for raw in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(raw)
        packers.append(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    found = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    for i, text in rows:
        data = (text or "").encode()
        if not data:
            assert abs(found[i] - found[501]) < 1e-12
            continue
        good, bad = (sum(len(p.compress(data[k : k + 1024])) for k in range(0, len(data), 1024)) for p in packers)
        left = math.log(min(good, bad) / len(data))
        x = model.shift + sum(s * (v - m) for s, v, m in zip(model.slopes, ((bad - good) / max(bad, good), left, left * left), model.means))
        assert abs(found[i] - 1 / (1 + math.exp(-x))) < 1e-9
    right = [(found[i] >= 0.5) == bool(i % 2) for i in range(200)]
    assert sum(right) > 180
