import math

import pytest
from pyspark.sql import functions as F

from paperlens.functions import stats, text, vectors
from paperlens.functions.dates import is_sort_date
from paperlens.functions.percentile import percentile_in


@pytest.mark.parametrize("source, wanted", [
    ("gain +1.3 % p = 1.3 and 1.3 = x, 1.3 (n=4) y\nz",
     "gain sodadpct p sodadnumexpr and sodadnumexpr x, sodadnum y z"),
    ("+/- 2 mm", " sodadnum mm"),
    ("a\tb  c", "a b c"),
    ("((n) m)", " m)"),
    ("", ""),
])
def test_masks(spark, source, wanted):
    df = spark.createDataFrame([(source,)], "t string")
    assert df.select(text.mask(F.col("t"))).first()[0] == wanted


def test_own_masks(spark):
    df = spark.createDataFrame([("H2O",)], "t string")
    assert df.select(text.mask(F.col("t"), [(r"\d", "#")])).first()[0] == "H#O"


def test_sentences_and_tokens(spark):
    df = spark.createDataFrame([("It cost 1.3% ok? Yes. Don't x-ray\nÉté",)], "t string")
    row = df.select(
        text.sentences(F.col("t")).alias("s"), text.tokens(F.col("t"), F.lower).alias("k")
    ).first()
    assert row.s == ["It cost 1.3% ok?", "Yes.", "Don't x-ray", "Été"]
    assert row.k == ["it", "cost", "1.3", "%", "ok", "?", "yes", ".", "don't", "x-ray", "été"]


@pytest.mark.parametrize("value, accepted", [
    ("20141231", False), ("20150101", True), ("20150231", True), ("2015-01-01", False),
    ("20150131\n", False), ("20200101", False), ("20151301", False),
])
def test_sort_dates(spark, value, accepted):
    df = spark.createDataFrame([(value,)], "d string")
    assert df.select(is_sort_date(F.col("d"))).first()[0] is accepted


def test_erf_and_normal(spark):
    xs = [-7.0, -3.2, -1.0, -1e-9, 0.0, 0.3, 1.0, 2.5, 4.7, 5.999, 6.0, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in df.select("x", stats.erf(F.col("x")).alias("e"), stats.normal_cdf(F.col("x")).alias("p")).collect():
        assert row.e == pytest.approx(math.erf(row.x), abs=2e-15)
        assert row.p == pytest.approx(0.5 * (1 + math.erf(row.x / math.sqrt(2))), abs=2e-15)


def test_over_representation(spark):
    df = spark.createDataFrame(
        [(0.1, 100.0, 0.3, 20.0), (0.3, 100.0, 0.1, 20.0), (1.0, 100.0, 1.0, 20.0), (0.0, 0.0, 0.1, 20.0)],
        "pr double, nr double, pt double, nt double",
    )
    got = [r[0] for r in df.select(stats.over_representation(*[F.col(c) for c in df.columns])).collect()]
    error = math.sqrt(0.1 * 0.9 / 100 + 0.3 * 0.7 / 20)
    assert got[0] == pytest.approx(math.erf(0.2 / error / math.sqrt(2)), abs=1e-12)
    assert got[1:] == [0.0, 0.0, 0.0]


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "x array<double>, y array<double>")
    row = df.select(
        vectors.sq_l2(F.col("x"), F.col("y")), vectors.scale(F.col("x"), F.lit(2.0)),
        vectors.add(F.col("x"), F.col("y")), vectors.divide(F.col("x"), F.lit(0.0)),
        vectors.one_hot(F.lit(1), 3),
    ).first()
    assert tuple(row) == (13.0, [2.0, 4.0], [4.0, 7.0], [None, None], [0, 1, 0])


def test_unequal_vectors_raise(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "x array<double>, y array<double>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(vectors.sq_l2(F.col("x"), F.col("y"))).collect()


@pytest.mark.parametrize("x, wanted", [
    (0.0, 0.0), (1.0, 0.0), (1.5, 0.0), (3.0, 0.5), (4.0, 1.0), (float("nan"), 0.0), (None, None),
])
def test_percentile_in(spark, x, wanted):
    df = spark.createDataFrame([(x, [(1.0, 0.0), (2.0, 0.5), (3.0, 1.0)])],
                               "x double, d array<struct<value: double, ptile: double>>")
    assert df.select(percentile_in(F.col("x"), F.col("d"))).first()[0] == wanted


def test_percentile_in_nothing(spark):
    df = spark.createDataFrame([(2.0, [])], "x double, d array<struct<value: double, ptile: double>>")
    assert df.select(percentile_in(F.col("x"), F.col("d"))).first()[0] == 1.0
