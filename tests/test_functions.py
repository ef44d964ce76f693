from __future__ import annotations

import random

from pyspark.sql import functions as F

from isopanel.functions import numeric as nu
from isopanel.functions import text as tx
from isopanel.sources.countries import standard_countries, with_counts


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"id int, x {kind}")


def column_of(df, name):
    return [row[name] for row in df.orderBy("id").collect()]


def test_number_text(spark):
    texts = ["n/a", "", "NaN", "12d", "1,234", "inf", " 12 ", "1e3", "-.5", "7.", "1f", "0x10", None, "-Infinity"]
    got = column_of(one_column(spark, texts).withColumn("y", nu.parse_number("x")), "y")
    inf = float("inf")
    assert got == [None, None, None, None, None, inf, 12.0, 1000.0, -0.5, 7.0, None, None, None, -inf]


def test_year_text(spark):
    texts = ["2001.7", "abc", "", "2001", " 1999 ", "-3.9", "1e12", "inf"]
    got = column_of(one_column(spark, texts).withColumn("y", nu.parse_year("x")), "y")
    assert got == [2001, None, None, 2001, 1999, -3, None, None]


def test_missing_tokens(spark):
    got = column_of(one_column(spark, ["NA", "null", "Nauru", "", "<NA>", "none"]).withColumn("y", nu.blank_to_null("x")), "y")
    assert got == [None, None, "Nauru", None, None, "none"]


def test_round_exact_agrees_with_decimal_text(spark):
    rng = random.Random(5)
    values = [0.125, 2.675, 1.0005, -0.001, -0.0004, 0.0, 1e15 + 0.5, 123456.7895]
    values += [rng.uniform(-1e6, 1e6) for _ in range(500)] + [k / 2000 for k in range(-400, 400)]
    df = one_column(spark, values, "double")
    for digits in (0, 1, 2, 3, 4, 6):
        got = column_of(df.withColumn("y", nu.round_exact("x", digits)), "y")
        assert got == [round(v, digits) + 0.0 for v in values], digits
        text = column_of(df.withColumn("y", nu.fixed_text("x", digits)), "y")
        assert text == [f"{v:.{digits}f}" for v in values], digits


def test_rounding_passes_infinity_and_null(spark):
    df = one_column(spark, [float("inf"), float("-inf"), None], "double")
    assert column_of(df.withColumn("y", nu.round_exact("x", 2)), "y") == [float("inf"), float("-inf"), None]
    assert column_of(df.withColumn("y", nu.fixed_text("x", 2)), "y") == ["inf", "-inf", None]


def test_labels(spark):
    labels = ["Total", "Renewable (total)", "TOTAL", "Oil", None]
    df = one_column(spark, labels)
    assert column_of(df.withColumn("y", tx.is_subtotal("x")), "y") == [True, True, True, False, False]
    assert column_of(df.withColumn("y", tx.differs_from("x", "Total")), "y") == [False, True, True, True, True]


def test_templates(spark):
    df = one_column(spark, ["a", None])
    filled = df.withColumn("y", tx.fill("<{x}> and {x}!", x="x"))
    assert column_of(filled, "y") == ["<a> and a!", None]
    joined = df.withColumn("y", tx.sentences(F.lit("One."), tx.fill("{x}.", x="x")))
    assert column_of(joined, "y") == ["One. a.", "One."]


def test_country_dimension(spark):
    dim = with_counts(standard_countries(spark), "population", "area_km2")
    rows = {r["country"]: r for r in dim.collect()}
    assert len(rows) == 22
    assert rows["Papua New Guinea"]["population_count"] == 10329931
    assert rows["Papua New Guinea"]["area_km2_count"] == 462840
    assert rows["Fiji"]["flag"] == "\U0001F1EB\U0001F1EF"
    assert rows["Wallis and Futuna"]["flag"] == "\U0001F1FC\U0001F1EB"
