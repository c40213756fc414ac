"""Writers of versioned Parquet tables and of CSV files.

A table is a folder of versions, each a whole table. A change reads the newest
version, writes the next one beside it, and leaves the old: a job that is lost
on its way leaves no version behind that can be read, as Spark marks a whole one
with _SUCCESS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataform.functions.labels import redacted


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the table's whole versions, in order."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    whole = [n for n in names if n.startswith("v") and n[1:].isdigit() and files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n[1:]) for n in whole)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of a table, the newest if none is named; None if there is none. A named one that isn't there fails."""
    held = versions(spark, path)
    if version is not None and version not in held:
        raise ValueError(f"{path} has no version {version}")
    return spark.read.parquet(f"{path}/v{held[-1] if version is None else version}") if held else None


class Conflict(RuntimeError):
    """Another writer has taken the version that was to be written."""


def _claim(path: str, version: int) -> str:
    return f"{path}/v{version}.claim"


def _write(spark: SparkSession, path: str, rows: DataFrame, base: int) -> None:
    """Write the version after ``base``. Who creates its claim first writes it; every other writer fails."""
    files, place = _folder(spark, _claim(path, base + 1))
    if not files.createNewFile(place):
        raise Conflict(f"{path}: version {base + 1} is being written, or a lost job left its claim (see release)")
    try:
        rows.write.mode("overwrite").parquet(f"{path}/v{base + 1}")
    except BaseException:
        files.delete(place, False)
        raise


def release(spark: SparkSession, path: str) -> None:
    """Give up the claim of a job that was lost before its version was whole; only for when no job writes the table."""
    files, place = _folder(spark, _claim(path, _newest(spark, path) + 1))
    files.delete(place, False)


def _newest(spark: SparkSession, path: str) -> int:
    return max(versions(spark, path), default=0)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], material: list[str]) -> dict[str, int]:
    """Write rows by key; how many were created, changed and unchanged.

    A held row is replaced only if a ``material`` column differs (nulls are
    equal); otherwise it stays as it is, provenance included. Keys compare null
    with null. Rows that share a key are refused, as which of them wins isn't
    defined. An empty delivery changes nothing; no new version is written then.
    """
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("two delivered rows share a key")
    base = _newest(spark, path)
    held = read_version(spark, path, base) if base else None
    if held is None:
        _write(spark, path, rows, base)
        return {"created": read_version(spark, path).count(), "changed": 0, "unchanged": 0}
    both = _matched(held, rows, keys)
    differs = F.lit(False)
    for c in material:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    kind = F.when(F.col("o.__here").isNull(), "created").when(F.col("n.__here").isNull(), "kept").when(differs, "changed").otherwise("unchanged")
    counts = {r["kind"]: r["count"] for r in both.groupBy(kind.alias("kind")).count().collect()}
    if counts.get("created") or counts.get("changed"):
        new = kind.isin("created", "changed")
        _write(spark, path, both.select(*[F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in held.columns]), base)
    return {k: counts.get(k, 0) for k in ("created", "changed", "unchanged")}


def _matched(held: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    o, n = held.withColumn("__here", F.lit(True)).alias("o"), rows.select(*held.columns).withColumn("__here", F.lit(True)).alias("n")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return o.join(n, met, "full")


def insert_new(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> dict[str, int]:
    """Add the rows whose key isn't held; of delivered rows that share a key any one. How many were inserted and skipped."""
    total, base = rows.count(), _newest(spark, path)
    held = read_version(spark, path, base) if base else None
    rows = rows.dropDuplicates(keys)
    if held is None:
        _write(spark, path, rows, base)
        inserted = read_version(spark, path).count()
    else:
        both = _matched(held, rows, keys)
        inserted = both.where("o.__here IS NULL").count()
        if inserted:
            _write(spark, path, both.select(*[F.when(F.col("o.__here"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in held.columns]), base)
    return {"inserted": inserted, "skipped": total - inserted}


def refresh_source(spark: SparkSession, path: str, rows: DataFrame, source_col: str, source: str) -> dict[str, int]:
    """Make a delivery all that is held of its source; other sources stay. How many rows were retired and are held.

    Rows of another source in the delivery are refused. What is stored is read
    again and compared with the delivery, both ways.
    """
    if not rows.where(~F.col(source_col).eqNullSafe(F.lit(source))).isEmpty():
        raise ValueError(f"rows of a source that isn't {source}")
    base = _newest(spark, path)
    held = read_version(spark, path, base) if base else None
    retired = 0 if held is None else held.where(F.col(source_col) == source).count()
    rest = None if held is None else held.where(~F.col(source_col).eqNullSafe(F.lit(source)))
    _write(spark, path, rows if rest is None else rest.unionByName(rows), base)
    stored = read_version(spark, path, base + 1).where(F.col(source_col) == source).select(*rows.columns)
    if not stored.exceptAll(rows).isEmpty() or not rows.exceptAll(stored).isEmpty():
        raise ValueError(f"what is stored of {source} isn't what was delivered")
    return {"retired": retired, "held": stored.count()}


def keep_raw(spark: SparkSession, path: str, responses: DataFrame) -> DataFrame:
    """Store raw responses once, without their secrets, and return each with the digest that it is held by.

    ``responses``: source, endpoint, period, version and payload (JSON text). The
    key is source, endpoint, period, version and the digest of the payload after
    its secrets are gone, so a response that comes again, with another key of
    access, is the one that is held. Null periods and payloads are values.
    """
    clean = responses.withColumn("payload", redacted(F.col("payload")))
    clean = clean.withColumn("digest", F.sha2(F.coalesce("payload", F.lit("\0")), 256))
    insert_new(spark, path, clean.select("source", "endpoint", "period", "version", "digest", "payload"), ["source", "endpoint", "period", "version", "digest"])
    return clean.select("source", "endpoint", "period", "version", "digest")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files as spreadsheets read them: UTF-8 with a mark in front of the header, CRLF, RFC 4180 quotes.

    Texts that a spreadsheet would take for a formula get an apostrophe in
    front. Nulls are empty cells. One header stands in each part file; a table
    without rows is one file with nothing but the header.
    """
    cells = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`").cast("string")
        guarded = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c) if kind == "string" else c
        cells.append(_quoted(F.coalesce(guarded, F.lit(""))))
    line = F.concat(F.concat_ws(",", *cells), F.lit("\r"))
    header = "﻿" + ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in df.columns) + "\r"

    if df.isEmpty():
        df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
        return

    def with_header(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([header])], schema=b.schema)
                first = False
            yield b

    df.select(line.alias("value")).mapInArrow(with_header, "value string").write.mode("errorifexists").text(path)


def _quoted(c):
    return F.when(c.rlike(r'[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
