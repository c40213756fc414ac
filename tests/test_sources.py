"""Readers and writers, by round trips through files."""

from __future__ import annotations

import csv
import glob
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataform.sources import files, sinks


def test_pages_are_read_whole_or_not_at_all(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"totalCount": 5, "data": [{"id": 2 * i + k, "name": None} for k in range(2 if i < 2 else 1)]}))
    got = files.read_pages(spark, str(tmp_path), "id long, name string")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]
    (tmp_path / "p2.json").write_text(json.dumps({"totalCount": 5, "data": []}))
    with pytest.raises(files.IncompleteDelivery):
        files.read_pages(spark, str(tmp_path), "id long, name string")
    (tmp_path / "p2.json").write_text(json.dumps({"data": [{"id": 4}]}))
    with pytest.raises(files.IncompleteDelivery):
        files.read_pages(spark, str(tmp_path), "id long, name string")


def test_wide_months_of_a_legacy_encoding(spark, tmp_path):
    text = '행정구역,2024년01월_총인구수,2024년01월_세대수,2024년02월_총인구수\n"동구  (2814000000)","1,234",5,0\n이름만,x,1,\n'
    (tmp_path / "p.csv").write_bytes(text.encode("cp949"))
    got = {(r.name, r.code, r.month): (r.population, r.reason) for r in files.read_wide_months(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {("동구", "2814000000", "2024-01"): (1234, None), ("동구", "2814000000", "2024-02"): (None, "UNPUBLISHED"), ("이름만", None, "2024-01"): (None, "NOT_INTEGER"), ("이름만", None, "2024-02"): (None, "UNPUBLISHED")}


def test_inventory_skips_lock_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/x.xlsx", "a/b/y.xlsx", "a/~$x.xlsx"):
        (tmp_path / name).write_bytes(name.encode())
    got = {r.name: (r.bytes, r.sha256) for r in files.file_inventory(spark, str(tmp_path), "*.xlsx").collect()}
    assert got == {n.rsplit("/")[-1]: (len(n), hashlib.sha256(n.encode()).hexdigest()) for n in ("a/x.xlsx", "a/b/y.xlsx")}


def test_features_round_trip(spark, tmp_path):
    """A region of two islands, one with a lake; points in the lake are outside."""
    from strataform.operators.spatial import points_in_shapes

    def square(x, y, w):
        return [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]

    shapes = [("a", [[square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)], [square(6.0, 0.0, 1.0)]]), ("b", [[square(8.0, 0.0, 1.0)]])]
    rows = spark.createDataFrame(shapes, f"code string, shape {files.SHAPE}")
    made = [json.loads(r.feature) for r in files.features_json(rows).collect()]
    assert [m["geometry"]["type"] for m in made] == ["MultiPolygon", "Polygon"] and made[0]["geometry"]["coordinates"][0][1][0] == made[0]["geometry"]["coordinates"][0][1][-1] == [1.0, 1.0]
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [*made, {"type": "Feature", "properties": {"code": "c"}, "geometry": None}]}))
    got = files.read_features(spark, str(path), "code: string")
    assert sorted(got.where("shape IS NOT NULL").collect()) == sorted(rows.collect()) and got.where("shape IS NULL").count() == 1
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 6.5, 0.5), (4, 5.0, 0.5), (5, 8.5, 0.5), (6, None, 1.0)], "p long, x double, y double")
    held = points_in_shapes(points, got.select("code", F.flatten("shape").alias("rings")))
    assert {(r.p, r.code) for r in held.collect()} == {(1, "a"), (3, "a"), (5, "b")}
    for bad in ({"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": "x"}):
        path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"code": "c"}, "geometry": bad}]}))
        with pytest.raises(Exception):
            files.read_features(spark, str(path), "code: string").collect()
    with pytest.raises(Exception):
        files.features_json(rows.select("code", F.lit(None).cast(files.SHAPE).alias("shape"))).collect()


def test_distances_hold_at_all_latitudes(spark):
    from strataform.operators.spatial import points_near_shapes

    schema = "id long, rings array<array<struct<x: double, y: double>>>"
    for lat in (-80.0, 0.0, 30.0, 70.0, 80.0, 88.0):
        shapes = spark.createDataFrame([(1, [[(10.0, lat), (11.0, lat), (11.0, lat + 0.5), (10.0, lat + 0.5)]])], schema)
        east = 11.0 + 4900 / 111195.08 / math.cos(math.radians(lat + 0.25))
        points = spark.createDataFrame([(1, east, lat + 0.25), (2, 11.0 + (east - 11.0) * 1.05, lat + 0.25)], "p long, x double, y double")
        assert [(r.p, round(r.metres)) for r in points_near_shapes(points, shapes, 5000.0).collect()] == [(1, 4900)]
    with pytest.raises(Exception):
        points_near_shapes(points, spark.createDataFrame([(1, [[(0.0, 89.0), (1.0, 89.0), (1.0, 89.9)]])], schema), 5000.0).collect()


def test_upsert_changes_only_what_matters(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v long, run string"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    assert sinks.upsert(spark, path, make((1, 10, "a"), (2, None, "a"), (None, 5, "a")), ["k"], ["v"]) == {"created": 3, "changed": 0, "unchanged": 0}
    assert sinks.upsert(spark, path, make((1, 10, "b"), (2, 7, "b"), (3, 1, "b"), (None, 5, "b")), ["k"], ["v"]) == {"created": 1, "changed": 1, "unchanged": 2}
    assert {tuple(r) for r in sinks.read_version(spark, path).collect()} == {(1, 10, "a"), (2, 7, "b"), (3, 1, "b"), (None, 5, "a")}
    assert sinks.upsert(spark, path, make((1, 10, "c")), ["k"], ["v"])["unchanged"] == 1
    assert sinks.versions(spark, path) == [1, 2]
    with pytest.raises(ValueError):
        sinks.upsert(spark, path, make((1, 1, "d"), (1, 2, "d")), ["k"], ["v"])
    assert {tuple(r) for r in sinks.read_version(spark, path, 1).collect()} == {(1, 10, "a"), (2, None, "a"), (None, 5, "a")}


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.insert_new(spark, path, spark.range(2), ["id"])
    sinks._write(spark, path, spark.range(3), 1)
    with pytest.raises(sinks.Conflict):
        sinks._write(spark, path, spark.range(4), 1)
    assert sinks.read_version(spark, path).count() == 3
    (tmp_path / "t" / "v3.claim").write_text("")  # a lost job
    with pytest.raises(sinks.Conflict):
        sinks.insert_new(spark, path, spark.range(5), ["id"])
    sinks.release(spark, path)
    assert sinks.insert_new(spark, path, spark.range(5), ["id"]) == {"inserted": 2, "skipped": 3}


def test_csv_of_an_empty_table_has_its_header(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([], "a string, `b,c` long"), str(tmp_path / "c"))
    assert b"".join(open(p, "rb").read() for p in glob.glob(f"{tmp_path}/c/part-*")) == b'\xef\xbb\xbfa,"b,c"\r\n'


def test_insert_new_counts_what_it_skips(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.insert_new(spark, path, spark.range(3), ["id"]) == {"inserted": 3, "skipped": 0}
    assert sinks.insert_new(spark, path, spark.range(1, 5).union(spark.range(4, 5)), ["id"]) == {"inserted": 2, "skipped": 3}
    assert sorted(r.id for r in sinks.read_version(spark, path).collect()) == [0, 1, 2, 3, 4]


def test_refresh_retires_a_source(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame(rows, "source string, v long")
    sinks.refresh_source(spark, path, make(("a", 1), ("a", 1)), "source", "a")
    sinks.refresh_source(spark, path, make(("b", 2)), "source", "b")
    assert sinks.refresh_source(spark, path, make(("a", 3)), "source", "a") == {"retired": 2, "held": 1}
    assert {tuple(r) for r in sinks.read_version(spark, path).collect()} == {("a", 3), ("b", 2)}
    with pytest.raises(ValueError):
        sinks.refresh_source(spark, path, make(("c", 3)), "source", "a")


def test_csv_is_guarded_and_quoted(spark, tmp_path):
    rows = [("=1+1", 1), ('say "hi", you', -2), (None, None), ("two\nlines", 3)]
    sinks.write_csv(spark.createDataFrame(rows, "`a,b` string, n long").coalesce(1), str(tmp_path / "c"))
    (part,) = glob.glob(f"{tmp_path}/c/part-*")
    data = open(part, "rb").read()
    assert data.startswith(b"\xef\xbb\xbf") and data.endswith(b"\r\n")
    got = list(csv.reader(data.decode("utf-8-sig").replace("\r\n", "\n").splitlines(keepends=True)))
    assert got == [["a,b", "n"], ["'=1+1", "1"], ['say "hi", you', "-2"], ["", ""], ["two\nlines", "3"]]


def test_nearest_sites_match_brute_force(spark):
    """Few sites, far ones and ties, more asked for than there are."""
    from strataform.operators.spatial import nearest_sites

    sites = [(i, float(i % 4) * 3, float(i // 4) * 5) for i in range(9)]
    points = [(i, i * 0.7, i * 0.3) for i in range(12)] + [(50, 120.0, -40.0)]
    for k in (1, 3, 20):
        got = nearest_sites(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(sites, "s long, x double, y double"), "p", "s", k=k).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("rank", "s"))).alias("r")).collect()
        wanted = {p: [s for _, s in sorted((((sx - x) ** 2 + (sy - y) ** 2) ** 0.5, s) for s, sx, sy in sites)[:k]] for p, x, y in points}
        assert {r.p: [e.s for e in r.r] for r in got} == wanted


def test_nearest_sites_of_crowds(spark):
    """Thousands of sites in one spot and at one place, points among them and far away, odd rows: the walk meets few sites."""
    from strataform.operators import spatial

    draw = np.random.Generator(np.random.PCG64(3))
    spot = np.concatenate([127 + draw.random((3000, 2)) * 1e-4, np.full((500, 2), 127.00005), 120 + draw.random((200, 2)) * 10])
    sites = [(int(i), *map(float, xy)) for i, xy in zip(draw.permutation(len(spot)), spot)]
    asked = np.concatenate([127 + draw.random((40, 2)) * 1e-4, 118 + draw.random((20, 2)) * 14, [[-170.0, 80.0], [127.00005, 127.00005]]])
    points = [(i, *map(float, xy)) for i, xy in enumerate(asked)]
    odd = [(None, 127.0, 127.0), (900, None, 1.0), (901, 1.0, float("nan"))]
    p, s = spark.createDataFrame(points + odd, "p long, x double, y double"), spark.createDataFrame(sites + odd, "s long, x double, y double")
    got = spatial.nearest_sites(p, s, "p", "s", k=4).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("rank", "s"))).alias("r")).collect()
    wanted = {i: [s for _, s in sorted((((sx - x) * (sx - x) + (sy - y) * (sy - y)) ** 0.5, s) for s, sx, sy in sites)[:4]] for i, x, y in points}
    assert {r.p: [e.s for e in r.r] for r in got} == wanted
    assert spatial.nearest_sites(p, s.limit(0), "p", "s").count() == spatial.nearest_sites(p.limit(0), s, "p", "s").count() == 0
    tree = spatial._site_tree(s.where("s < 900").select(F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("s") * 300_000).cast("int").alias("ix"), F.lit(5).alias("iy")), 16)
    leaves = tree.where("NOT split").agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    assert leaves["all"] == s.where("s < 900").count() and leaves["most"] <= 16


def test_places_walk_to_their_sites_in_groups(spark, monkeypatch):
    """Points that share places, clusters, ids of text, a place at infinity: a group of places is a row of the walk."""
    from strataform.operators import spatial

    walks, staged = [], spatial.staged

    def counted(df):
        out = staged(df)
        if "nodes" in out.columns:
            walks.append(out.count())
        return out

    monkeypatch.setattr(spatial, "staged", counted)
    draw = np.random.Generator(np.random.PCG64(4))
    grid = np.stack(np.meshgrid(np.arange(20.0), np.arange(20.0)), -1).reshape(-1, 2)
    spots = np.concatenate([grid, 5 + draw.random((800, 2)) * 0.01, draw.normal(12, 1, (800, 2))])
    asked = np.concatenate([draw.integers(0, 40, (1500, 2)) / 2.0, 5 + draw.random((1500, 2)) * 0.01, draw.normal(12, 1, (1500, 2)), [[float("inf"), 3.0]]]).repeat(2, axis=0)
    names = np.array([f"s{n}" for n in draw.permutation(len(spots))])
    p = spark.createDataFrame([(i, *map(float, xy)) for i, xy in enumerate(asked)], "p long, x double, y double")
    s = spark.createDataFrame([(str(n), *map(float, xy)) for n, xy in zip(names, spots)], "s string, x double, y double")
    got = {r.p: [e.s for e in r.r] for r in spatial.nearest_sites(p, s, "p", "s").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("rank", "s"))).alias("r")).collect()}
    order = np.argsort(names)
    for i, (x, y) in enumerate(asked):
        near = order[np.argsort(np.sqrt((spots[order, 0] - x) ** 2 + (spots[order, 1] - y) ** 2), kind="stable")[:5]]
        assert got[i] == names[near].tolist(), i
    assert len(got) == len(asked) and max(walks) < len(asked) / 8


def test_sites_are_held_against_places_a_pool_at_a_time(monkeypatch):
    from strataform.operators import spatial

    monkeypatch.setattr(spatial, "POOL", 16)
    draw = np.random.Generator(np.random.PCG64(5))
    rows, wanted = [], set()
    for g, (n, m) in enumerate([(3, 200), (1, 2), (4, 0), (5, 40)]):
        places, sites = draw.integers(0, 50, (n, 2)) + g * 0.01 + np.arange(n)[:, None] * 1e-4, draw.integers(0, 50, (m, 2))
        rows += [(g, False, None, *map(float, xy)) for xy in places] + [(g, True, (1 << 60) + int(i), *map(float, xy)) for i, xy in zip(draw.permutation(m), sites)]
        own = [r for r in rows if r[0] == g and r[1]]
        for x, y in places.tolist():
            wanted |= {(x, y, s, rank) for rank, (_, s) in enumerate(sorted((((sx - x) ** 2 + (sy - y) ** 2) ** 0.5, s) for _, _, s, sx, sy in own)[:5], 1)}
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64()))], names=["g", "site", "s", "x", "y"])
    found = pa.Table.from_batches(spatial._ranked(5, pa.int64())(table.to_batches(max_chunksize=7)))
    assert {(r["x"], r["y"], r["s"], r["rank"]) for r in found.to_pylist()} == wanted


def test_facilities_of_several_data_sets(spark, tmp_path):
    row = {"name": "시설", "sido": "경기도", "sigungu": "용인시", "address": "길 1", "LANDFILL_QTY": "1,000", "FILL_AREA": "5", "DISPOSAL_QTY": "7", "RESIDUE_RECY": "x"}
    pages = {"a": ("P1", [row, {**row, "name": "합계"}, {**row, "address": " "}, row]), "b": ("P2", [row, {**row, "RESIDUE_RECY": "-"}])}
    for name, (pid, rows) in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"pid": pid, "year": 2024, "code": "OK", "data": rows}))
    (tmp_path / "c.json").write_text(json.dumps({"pid": "P2", "year": 2024, "code": "NO_DATA"}))
    kinds = {"P1": "LANDFILL", "P2": "INCINERATION"}
    found = files.read_facilities(spark, str(tmp_path), kinds, 2024).orderBy("pid", "place").collect()
    assert [(r.pid, r.outcome, r.reason, r["index"]) for r in found] == [
        ("P1", "RECORD", None, 0), ("P1", "AGGREGATE", None, None), ("P1", "REJECTED", "missing address", 1), ("P1", "RECORD", None, 2),
        ("P2", "REJECTED", "RESIDUE_RECY NOT_NUMERIC", 0), ("P2", "RECORD", None, 1),
    ]
    assert (float(found[0].throughput), float(found[0].fill_area_m2), found[0].residue_recycling) == (1000.0, 5.0, None) and (float(found[5].throughput), found[5].fill_area_m2) == (7.0, None)
    (tmp_path / "d.json").write_text(json.dumps({"pid": "P1", "year": 2023, "code": "OK", "data": []}))
    with pytest.raises(files.IncompleteDelivery):
        files.read_facilities(spark, str(tmp_path), kinds, 2024)


def test_discovery_by_a_manifest(spark):
    manifest = spark.createDataFrame([("d", "roads", "r", ".shp", "REQUIRED"), ("d", "rivers", "v", ".shp", "REQUIRED"), ("d", "parks", "p", ".shp", "OPTIONAL"), ("d", "mines", "m", ".shp", "UNPUBLISHED"), ("d", "bays", "b", ".shp", "UNPUBLISHED"), ("d", "hills", "h", ".shp", "REQUIRED")], "dataset string, layer string, folder string, suffix string, coverage string")
    found = files.discover(spark.createDataFrame([("/x/r/a.shp",), ("/x/b/a.shp",), ("/x/h/a.shp",), ("/x/h/b.shp",), ("/x/r/a.dbf",)], "path string"), manifest)
    assert {(r.layer, r.path, r.state) for r in found.collect()} == {
        ("roads", "/x/r/a.shp", "FOUND"), ("rivers", None, "MISSING"), ("parks", None, "ABSENT"), ("mines", None, "UNPUBLISHED"), ("bays", "/x/b/a.shp", "UNEXPECTED"),
        ("hills", "/x/h/a.shp", "DUPLICATE"), ("hills", "/x/h/b.shp", "DUPLICATE"), (None, "/x/r/a.dbf", "UNEXPECTED"),
    }


def test_raw_responses_are_kept_once_without_secrets(spark, tmp_path):
    path, schema = str(tmp_path / "raw"), "source string, endpoint string, period string, version string, payload string"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    first = sinks.keep_raw(spark, path, make(("s", "e", "2024", "1", '{"apiKey": "a", "v": 1}'), ("s", "e", None, "1", None))).collect()
    again = sinks.keep_raw(spark, path, make(("s", "e", "2024", "1", '{"apiKey": "b", "v": 1}'), ("s", "e", "2024", "1", '{"apiKey": "b", "v": 2}'))).collect()
    assert first[0].digest == again[0].digest != again[1].digest
    held = sinks.read_version(spark, path).collect()
    assert len(held) == 3 and not any("apiKey" in (r.payload or "") and "REDACTED" not in r.payload for r in held)
