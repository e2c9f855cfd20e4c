"""The skew-proof building blocks against Spark's own windows and joins."""

import random

import pytest
from pyspark.sql import Window, functions as F

from paperlens.operators import frames
from paperlens.operators.authors import as_arrays, value_percentiles
from paperlens.functions.percentile import percentile_in
from paperlens.operators.percentiles import normalize


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Small tables would be coalesced into one slice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows have one key, many values are equal."""
    random.seed(3)
    data = [("hot" if i % 3 else f"k{i % 7}", random.randrange(200) / 4, i) for i in range(3000)]
    return spark.createDataFrame([*data, ("one", 1.0, -1)], "key string, value double, n long")


def test_percent_ranked(skewed, rows):
    window = Window.partitionBy("key").orderBy("value")
    wanted = skewed.withColumn("ptile", F.percent_rank().over(window))
    got = frames.percent_ranked(skewed, "key", "value").select(*wanted.columns)
    assert rows(got) == rows(wanted)


def test_value_percentiles(skewed, rows):
    window = Window.partitionBy("key").orderBy("value")
    wanted = skewed.select("key", "value", F.percent_rank().over(window)).distinct()
    assert rows(value_percentiles(skewed, "key", "value")) == rows(wanted)


def test_indexed(spark, rows):
    df = spark.createDataFrame([(random.randrange(9), i) for i in range(500)], "a int, b int")
    window = Window.orderBy(F.desc("a"), "b")
    wanted = df.withColumn("i", F.row_number().over(window) - 1)
    assert rows(frames.indexed(df, ["a", "b"], "i", descending=["a"])) == rows(wanted)


def test_normalize_equals_array_lookup(spark, skewed, rows):
    ptiles = value_percentiles(skewed, "key", "value")
    requests = spark.createDataFrame(
        [(k, x) for k in ("hot", "k1", "one", "absent")
         for x in (-1.0, 0.0, 0.1, 7.25, 30.0, 49.75, 49.8, float("nan"), None)], "key string, x double")
    arrays = requests.join(as_arrays(ptiles, "key", "value"), "key", "left")
    none = F.array().cast("array<struct<value: double, ptile: double>>")
    wanted = arrays.select("key", "x", percentile_in(F.col("x"), F.coalesce("distribution", none)))
    got = normalize(requests, ptiles, "key", "x", "value")
    assert [r[2] for r in rows(got) if r[1] == r[1]] == [r[2] for r in rows(wanted) if r[1] == r[1]]
    nan = [(r[0], r[2]) for r in got.collect() if r[1] != r[1]]
    assert sorted(nan) == [("absent", 1.0), ("hot", 0.0), ("k1", 0.0), ("one", 0.0)]


@pytest.mark.parametrize("block_rows", [1, 7, 10_000])
def test_pairs_within_blocks(spark, rows, block_rows):
    data = [("hot", f"m{i % 23}", i % 2) for i in range(60)] + [("b", "x", 0), ("b", "y", 1), (None, "z", 1), (None, "q", 1)]
    df = spark.createDataFrame(data, "key string, member string, c int")
    wanted = df.alias("a").join(df.alias("b"), F.expr("a.key = b.key and a.member < b.member")).select(
        "a.key", F.col("a.member"), F.col("b.member"), F.col("a.c"), F.col("b.c"))
    got = frames.pairs_within(
        df, "key", "member", ["c"], right_carry=["c"], ordered=lambda a, b: a < b, block_rows=block_rows)
    assert rows(got) == rows(wanted)


def test_slices_divide_a_hot_key(spark, skewed):
    sliced = skewed.select("key", "value").distinct().repartitionByRange("key", "value")
    assert sliced.where("key = 'hot'").select(F.spark_partition_id()).distinct().count() > 3


def test_bounds(spark):
    df = spark.range(10)
    assert frames.has_at_most(df, 10) and not frames.has_at_most(df, 9)
    with pytest.raises(ValueError, match="missing"):
        frames.require_columns(df, "x")


def test_hash_share_is_stable_and_uniform(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"))
    low = df.where(frames.hash_share("id", 5) < 0.8)
    assert 15_600 < low.count() < 16_400
    assert low.exceptAll(df.repartition(13).where(frames.hash_share("id", 5) < 0.8)).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookups_of_hot_keys(spark, rows, plan, monkeypatch, how):
    """A table too large to broadcast: the rows of the hot key stay where they are."""
    table = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "key string, n long")
    asked = spark.createDataFrame(
        [("k1", i) for i in range(90)] + [(f"k{i}", i) for i in range(2, 9)] + [("none", 1), (None, 2)], "key string, v long")
    wanted = rows(asked.join(table, "key", how))
    assert rows(frames.lookup_join(asked, table, "key", how=how)) == wanted
    monkeypatch.setattr(frames, "BROADCAST_BYTES", 1_000)
    split = frames.lookup_join(asked, table, "key", how=how, row_bytes=100)
    assert rows(split) == wanted
    assert "Union" in plan(split) and plan(split).count("BroadcastHashJoin") >= 3


def test_broadcasts_are_measured_in_rows_and_bytes(spark, plan):
    df = spark.createDataFrame([(i, "x" * 1_000) for i in range(50)], "key long, text string")
    other = spark.range(5).toDF("key")

    def hinted(**limits):
        return "hint" in other.join(frames.broadcast_if_small(df, **limits), "key")._jdf.queryExecution().analyzed().toString().lower()

    assert hinted() and not hinted(rows=49) and not hinted(size=40_000)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block_rows", [2_000, 7])
def test_pairs_back_in_time(spark, strict, block_rows):
    """One key with most rows, repeated members, null keys, times and parts of times."""
    given = [("hot" if i % 4 else f"k{i % 9}", i % 100, 2015 + i % 5, None if i % 17 == 0 else i % 12) for i in range(160)]
    given += [(None, 1, 2015, 1), ("hot", 2, None, 3), ("k1", 3, None, None)]
    df = spark.createDataFrame(given, "key string, member int, year int, month int")
    for time, of in ((F.col("year"), lambda r: None if r[2] is None else (r[2],)),
                     (F.struct("year", "month"), lambda r: tuple(-1 if v is None else v for v in r[2:]))):
        found = frames.pairs_back_in_time(df, "key", "member", time, ["year"], strict=strict, block_rows=block_rows)
        wanted = [
            (a[1], b[1], a[2]) for a in given for b in given if a[0] is not None and a[0] == b[0]
            and of(a) is not None and of(b) is not None and (of(b) < of(a) if strict else of(b) <= of(a))]
        key = lambda r: tuple(-1 if v is None else v for v in r)
        assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(wanted, key=key)
