"""URL filters over a sorted array of digests.

Rules are full strings, host and path prefix together. Their 64-bit xxhash keys
are sorted into one file with the strings behind them; every task maps the file
into memory, so that the workers of a machine share its pages and no task holds
the rules on its heap. A url probes the keys of its host suffixes with the path
prefixes of the lengths that rules have, a batch at a time by vectorised binary
search, and each hit is confirmed on the stored string, so that a collision
can't decide.

Nothing is shuffled. The file goes to each machine once; its size is that of
the rules, 16 bytes and the string for each.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataform.llm.common import fresh, lower_ascii, text_or_empty

#: Host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_host(url: str = "url") -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(text_or_empty(url), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: str = "url") -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(text_or_empty(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_index(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """Count, sorted keys, ends of the strings, string blob; later rules replace equal earlier ones."""
    held = {host + path: f"{len(host)}\t{verdict}\t{host}{path}" for host, path, verdict in rules}
    entries = sorted((xxhash.xxh64_intdigest(k), v.encode()) for k, v in held.items())
    keys = np.array([k for k, _ in entries], dtype="<u8")
    ends = np.cumsum([len(v) for _, v in entries], dtype="<i8") if entries else np.zeros(0, "<i8")
    lengths = np.array(sorted({len(p) for _, p, _ in rules}), dtype="<i8")
    head = np.array([len(keys), len(lengths)], dtype="<i8")
    return b"".join([head.tobytes(), lengths.tobytes(), keys.tobytes(), ends.tobytes(), *[v for _, v in entries]])


class DigestArray:
    """The index file, mapped into memory."""

    def __init__(self, path: str):
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        n, m = (int(x) for x in whole[:16].view("<i8"))
        at = 16
        self.lengths = [int(x) for x in whole[at : at + 8 * m].view("<i8")]
        at += 8 * m
        self.keys = whole[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = whole[at : at + 8 * n].view("<i8")
        self.blob = whole[at + 8 * n :]

    def entry(self, i: int) -> tuple[int, str, str]:
        """Length of the host, verdict, rule."""
        start = int(self.ends[i - 1]) if i else 0
        n, verdict, rule = self.blob[start : int(self.ends[i])].tobytes().decode().split("\t", 2)
        return int(n), verdict, rule

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """The longest rule of each url and its verdict; of equally long ones that with the longer host."""
        owner, names, hashes = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            prefixes = [path[:n] for n in self.lengths if n <= len(path)]
            at = 0
            while prefixes:
                for p in prefixes:
                    name = host[at:] + p
                    owner.append(i)
                    names.append((len(host) - at, name))
                    hashes.append(xxhash.xxh64_intdigest(name))
                at = host.find(".", at) + 1
                if not at:
                    break
        found: list[tuple[str | None, str | None]] = [(None, None)] * len(hosts)
        if not hashes or not len(self.keys):
            return found
        probe = np.array(hashes, dtype="<u8")
        low, high = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        best: dict[int, tuple[int, int]] = {}
        for j in np.flatnonzero(high > low):
            for k in range(low[j], high[j]):
                n, verdict, rule = self.entry(k)
                if (n, rule) == names[j] and (len(rule), n) > best.get(owner[j], (-1, -1)):
                    best[owner[j]] = (len(rule), n)
                    found[owner[j]] = (rule, verdict)
        return found


def _shipped(spark: SparkSession, index: bytes) -> str:
    name = f"url-rules-{hashlib.sha256(index).hexdigest()[:32]}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="url-rules-"), name)
    with open(path, "wb") as f:
        f.write(index)
    if not any(x.endswith("/" + name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def filter_urls(pages: DataFrame, url_col: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """The rows of ``pages`` with host, path, rule and verdict.

    Null urls and urls without :// have an empty host and path, fit no rule and
    get the default verdict. Repeated rows stay; input columns named like the
    four are replaced; an empty table or an empty list of rules works alike.
    """
    base = fresh(pages, "host", "path", "rule", "verdict")
    name = _shipped(pages.sparkSession, build_index(list(rules)))

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = DigestArray(SparkFiles.get(name))
        for hosts, paths in batches:
            found = index.judge(hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": [r for r, _ in found], "verdict": [v or default for _, v in found]}, dtype=object)

    judged_rows = base.withColumn("host", url_host(url_col)).withColumn("path", url_path(url_col)).withColumn("__j", judged("host", "path"))
    return judged_rows.select(*base.columns, "host", "path", F.col("__j.rule").alias("rule"), F.col("__j.verdict").alias("verdict"))
