"""National grids against an integral and their own inverse; faults of the cost scenario; odd addresses and notes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.functions import geodesy, labels
from strataform.operators.facility_cost import facility_cost


@pytest.mark.parametrize("code", [5179, 5186])
def test_grid_on_its_meridian_is_the_arc(spark, code):
    grid = geodesy.GRIDS[code]
    x, y = geodesy.to_grid(F.col("lon"), F.col("lat"), code)
    rows = spark.createDataFrame([(grid.lon0, 38.0), (grid.lon0, 33.0), (None, 33.0), (grid.lon0, 95.0)], "lon double, lat double").select(x, y).collect()
    e2 = geodesy.FLATTENING * (2 - geodesy.FLATTENING)
    phi = np.radians(np.linspace(33, 38, 200001))
    arc = np.trapezoid(geodesy.RADIUS * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    assert tuple(rows[0]) == pytest.approx((grid.east, grid.north), abs=1e-5)
    assert tuple(rows[1]) == pytest.approx((grid.east, grid.north - grid.scale * arc), abs=1e-3)
    assert tuple(rows[2]) == tuple(rows[3]) == (None, None)


def test_cost_faults_have_their_reasons(spark):
    good = ("INCINERATION", 36500.0, "0.5", 365, "1.20", "city_or_county", 1000)
    rows = [good, ("OTHER", *good[1:]), (*good[:2], "1.5", *good[3:]), (*good[:3], 0, *good[4:]), (*good[:4], "1.41", *good[5:]), (*good[:5], "x", 1000), (*good[:6], None), ("INCINERATION", None, *good[2:])]
    df = spark.createDataFrame(rows, "facility_type string, annual_ton double, share string, days int, multiplier string, scheme string, population long")
    df = df.withColumn("share", F.col("share").cast("decimal(5,4)")).withColumn("multiplier", F.col("multiplier").cast("decimal(4,2)"))
    out = facility_cost(df, [("INCINERATION", "0", "50", "5.2")]).collect()
    assert [r.reason for r in out] == [None, "UNSUPPORTED_FACILITY_TYPE", "INVALID_PROCESSING_SHARE", "INVALID_OPERATING_DAYS", "INVALID_UNDERGROUND_MULTIPLIER", "UNKNOWN_SUBSIDY_SCHEME", None, "INVALID_QUANTITY"]
    assert float(out[0].construction) == 312.0 and out[0].lifetime_years == 15 and float(out[0].annualised) == 20.8
    assert float(out[0].subsidy) == 93.6 and float(out[0].local_share) == 218.4 and float(out[0].won_per_person) == 21840000.0
    assert out[6].won_per_person is None and out[6].population_reason == "NO_OFFICIAL_SERVICE_POPULATION"
    assert all(r.construction is None for r in out[1:6])


def test_addresses_and_contractors_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None), ("", ""), ("(가)", "업체: "), ("수집 - (주)가", "업체: 나, (주)다")], "a string, b string")
    rows = df.select(labels.simple_address(F.col("a")).alias("a"), labels.contractor(F.col("a"), F.col("b")).alias("b")).collect()
    assert [r.a for r in rows] == [None, None, None, "수집 - 가"]
    assert [r.b for r in rows] == [None, None, None, "(주)가"]


def test_addresses_contractors_and_secrets(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    lit = F.lit
    for s, g, a, want in [
        ("경기도", "용인시", " 경기  용인시 길 3", "경기 용인시 길 3"), ("경기도", "용인시", "용인시 길 3", "경기도 용인시 길 3"), ("경기도", "용인시", "길 3", "경기도 용인시 길 3"),
        ("서울특별시", "중구", "서울시 중구 1", "서울시 중구 1"), ("부산", "중구", "부산 중구 1", "부산 중구 부산 중구 1"), ("경기도", "용인시", "서울 길", "경기도 용인시 서울 길"),
    ]:
        assert value(labels.request_address(lit(s), lit(g), lit(a))) == want
    for a, want in [("길 3(태평동)", "길 3"), ("가 (나) 다 (라", "가 다 (라"), ("리 12-1,2", "리 12-1"), ("리 12,3,4-5", "리 12"), ("리 12,", None), ("리 가,12", None), ("리 가,12,3", "리 가,12"), ("12,3 리", None), ("(가)", None), ("리 3 ", None)]:
        assert value(labels.simple_address(lit(a))) == want, a
    for name, note, want in [
        (None, "업체 갑, 업체: (주)을", "(주)을"), (None, "업체: 갑. 계약상대자 ㈜병 외; 끝", "㈜병 외"), ("가 - 나 - 주식회사 다", "업체: 갑", "주식회사 다"), ("주식회사 다", None, None),
        ("가 - 나", "계약상대방: 유한회사 라 .| 마", "유한회사 라"), (None, "업체: " + "가" * 300 + "(주)", "가" * 200),
    ]:
        assert value(labels.contractor(lit(name), lit(note))) == want
    for raw, want in [
        ('{"apiKey":"x","a":[{"ACCESS_TOKEN":{"b":[1,"}"]}},2]}', '{"apiKey":"[REDACTED]","a":[{"ACCESS_TOKEN":"[REDACTED]"},2]}'),
        ('{"key" : [1, {"x": "\\"]"}] , "monkey": "key", "z": "token: 1"}', '{"key" : "[REDACTED]" , "monkey": "key", "z": "token: 1"}'),
        ('{"t\\u006fken": -1.5e3, "secret": null, "usrId": true, "v": 1.10}', '{"t\\u006fken": "[REDACTED]", "secret": "[REDACTED]", "usrId": "[REDACTED]", "v": 1.10}'),
        ('["token", {"token": ""}]', '["token", {"token": "[REDACTED]"}]'), ("", ""), ('{"token": "unclosed', '{"token": "[REDACTED]"unclosed'),
    ]:
        assert value(labels.redacted(lit(raw))) == want, raw
    assert value(labels.redacted(lit('{"password": "' + "x" * 100_000 + '"}'))) == '{"password": "[REDACTED]"}'


def test_quantities_keep_six_places(spark):
    df = spark.createDataFrame([("INCINERATION", "36500.000499", "0.5", 365, "1.20", "city_or_county", 1000)], "facility_type string, annual_ton string, share string, days int, multiplier string, scheme string, population long")
    df = df.withColumn("annual_ton", F.col("annual_ton").cast("decimal(20,6)")).withColumn("share", F.col("share").cast("decimal(5,4)")).withColumn("multiplier", F.col("multiplier").cast("decimal(4,2)"))
    (row,) = facility_cost(df, [("INCINERATION", "0", "80", "5.2")]).collect()
    # the half of 36500.000499 is 18250.0002495: half to even at six places
    assert str(row.service_ton) == "18250.000250" and row.reason is None


def test_many_bands_meet_values_by_parts_of_the_axis(spark, monkeypatch):
    """More bands than are sent to all tasks give the same rows: overlaps, open ends, gaps, unbounded and null values."""
    from strataform.operators import lookup

    draw = np.random.Generator(np.random.PCG64(5))
    bands = [(f"b{i:03}", float(a), float(a + w), bool(o), bool(c)) for i, (a, w, o, c) in enumerate(zip(draw.integers(0, 900, 300), draw.integers(0, 3, 300), draw.integers(0, 2, 300), draw.integers(0, 2, 300)))]
    bands += [("back", 5.0, 1.0, False, False)]
    values = [(i, None if i % 50 == 0 else float(i % 1900) / 2) for i in range(2500)]
    facts = spark.createDataFrame(values, "id long, v double")
    for more in ([], [("low", None, 0.0, False, True)], [("all", None, None, False, False)]):
        table = spark.createDataFrame(bands + more, "band string, low double, high double, low_open boolean, high_open boolean")
        out = {}
        for few in (2000, 10):
            monkeypatch.setattr(lookup, "FEW", few)
            out[few] = sorted(map(tuple, lookup.band_join(facts, table, F.col("v")).collect()))
        assert out[2000] == out[10] and len(out[10]) == 2500


def test_redaction_over_lines_and_after_stray_marks(spark):
    cases = {
        '{"token":\n\t"x", "a": 1}': '{"token":\n\t"[REDACTED]", "a": 1}',
        ']{"secret": {"a": ["x"]}, "b": 2}': ']{"secret": "[REDACTED]", "b": 2}',
        '{"a": "\\"key\\": 1", "KEY": [1': '{"a": "\\"key\\": 1", "KEY": "[REDACTED]"',
    }
    rows = spark.createDataFrame([(x,) for x in [*cases, None]], "raw string")
    assert {r.raw: r.clean for r in rows.select("raw", labels.redacted("raw").alias("clean")).collect()} == {**cases, None: None}
