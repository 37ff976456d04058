from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shopstream.functions import measure, scoring, text
from shopstream.operators.analyse import lift, relax_terms


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "want"),
    [("beams", "beam"), ("berries", "berry"), ("boxes", "box"), ("benches", "bench"), ("glass", "glass"), ("focus", "focus"), ("gas", "gas"), ("ties", "tie")],
)
def test_singularise(spark, word, want):
    assert one(spark, text.singularise(F.lit(word))) == want


def test_tokenise_keeps_sizes_and_drops_marks(spark):
    assert one(spark, text.tokenise(F.lit(" The “Oak-Beam” 3-1/2 x 4' -- a.b. "))) == ["the", "oak-beam", "3-1/2", "x", "4", "a.b"]
    assert one(spark, text.tokenise(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("token", "want"), [("bmv4x6x120sm", True), ("4x6x12", False), ("12ft", False), ("beam", False), ("ab1", False)])
def test_looks_like_sku(spark, token, want):
    assert one(spark, text.looks_like_sku(F.lit(token))) is want


@pytest.mark.parametrize(("raw", "want"), [("3-1/2", 3.5), ("3 1/2", 3.5), ("1/2", 0.5), ("12", 12.0), ("1/0", None), ("x", None), ("3.25", 3.25)])
def test_measurements(spark, raw, want):
    assert one(spark, measure.parse_measurement(F.lit(raw))) == want


def test_attribute_inches(spark):
    assert one(spark, measure.attribute_inches(F.lit("width"), F.lit("3-1/2 ft"))) == 42.0
    assert one(spark, measure.attribute_inches(F.lit("finish"), F.lit("3"))) is None


def test_half_up_goes_towards_plus_infinity(spark):
    assert one(spark, scoring.half_up(F.lit(-2.5))) == -2.0
    assert one(spark, scoring.half_up(F.lit(2.5))) == 3.0


def test_hash32_agrees_with_plain_arithmetic(spark):
    def plain(s: str) -> int:
        h = 0x811C9DC5
        for c in s:
            h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> shift) * factor & 0xFFFFFFFF
        return h ^ h >> 16

    keys = [f"{e}:{s}" for e in (1, 77) for s in ("", "a", "session-12345", "x" * 40)]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", scoring.hash32(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in rows} == {k: plain(k) for k in keys}


def test_normal_cdf(spark):
    assert abs(one(spark, scoring.normal_cdf(F.lit(1.96))) - 0.975002) < 1e-5
    assert abs(one(spark, scoring.normal_cdf(F.lit(-1.96))) - 0.024998) < 1e-5


def test_lift_takes_sizes_before_single_measurements():
    assert lift("4x6 beam 12ft") == ("beam", [("width_in", 4.0), ("height_in", 6.0), ("length_in", 144.0)])
    assert lift('8"h x 6"w post') == ("post", [("height_in", 8.0), ("width_in", 6.0)])
    assert lift("24 inch medallion") == ("medallion", [("any_dimension_in", 24.0)])
    assert lift("1/0 in thing") == ("1/0 in thing", [])


def test_relax_drops_the_first_of_the_shortest(spark):
    assert one(spark, relax_terms(F.array(F.lit("oak"), F.lit("red"), F.lit("beam")))) == ["red", "beam"]
    assert one(spark, relax_terms(F.array(F.lit("oak")))) is None


def test_lift_reads_mixed_numbers_axes_and_written_on_crosses():
    assert lift("2-1/2 in thick board") == ("board", [("any_dimension_in", 2.5)])
    assert lift("5 1/2 inches wide shelf") == ("shelf", [("width_in", 5.5)])
    assert lift("width: 4 in post") == ("post", [("width_in", 4.0)])
    assert lift("4ftx6ft panel") == ("panel", [("width_in", 48.0), ("height_in", 72.0)])
    assert lift("2x4x8 stud") == ("stud", [("width_in", 2.0), ("height_in", 4.0), ("length_in", 8.0)])
    assert lift("abc4 in oak") == ("abc4 in oak", [])
