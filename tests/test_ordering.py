"""Chunked positions, running ranks and sessions against plain windows and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runloom.operators.ordering import exact_percentiles, value_ranks, with_chunks, with_position, with_session_start


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, many values are equal."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, float(rng.choice([0.0, 0.0, rng.random() * 100]))) for i in range(3000)]
    return spark.createDataFrame(rows, "key string, id long, v double").cache()


@pytest.mark.parametrize("chunks", [2, 7, 64])
def test_position_equals_one_window(skewed, chunks):
    placed = with_position(skewed, ["key"], ["v", "id"], chunks=chunks)
    plain = F.row_number().over(Window.partitionBy("key").orderBy("v", "id"))
    assert placed.withColumn("plain", plain).where(F.col("index") != F.col("plain")).count() == 0
    assert placed.count() == 3000


@pytest.mark.parametrize("chunks", [2, 7, 64])
def test_percentiles_equal_builtin(skewed, chunks):
    ours = exact_percentiles(skewed, ["key"], "v", {"a": 0.5, "b": 0.95, "c": 0.99}, chunks)
    builtin = skewed.groupBy("key").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    for row in ours.join(builtin, "key").collect():
        assert [row.a, row.b, row.c] == pytest.approx(row.p)


@pytest.mark.parametrize(
    "values,expected",
    [([1.0, 2.0, 3.0, 4.0, 5.0], (3.0, 4.8, 4.96)), ([7.0], (7.0, 7.0, 7.0)), ([1.0, 2.0], (1.5, 1.95, 1.99)), ([4.0] * 5, (4.0,) * 3)],
)
def test_percentile_values(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_percentiles(df, [], "v", {"a": 0.5, "b": 0.95, "c": 0.99}).first()
    assert (row.a, row.b, row.c) == pytest.approx(expected)


def test_null_order_values_come_first(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", 3.0, 2), ("k", 1.0, 3)], "key string, v double, id long")
    got = {r.id: r["index"] for r in with_position(df, ["key"], ["v", "id"], chunks=3).collect()}
    assert got == {1: 1, 3: 2, 2: 3}


def test_sessions_by_brute_force(skewed):
    rows = with_session_start(skewed.withColumn("t", F.col("id") + F.when(F.col("id") % 50 > 40, 30).otherwise(0)), ["key"], "t", "id", 20.0, chunks=9)
    by_key: dict[str, list] = {}
    for r in rows.collect():
        by_key.setdefault(r.key, []).append((r.t, r.id, r._session))
    for items in by_key.values():
        previous, start = None, None
        for t, _, session in sorted(items):
            if previous is None or t - previous >= 20.0:
                start = t
            previous = t
            assert session == start


def test_text_order_is_refused(spark):
    with pytest.raises(TypeError):
        with_position(spark.createDataFrame([("a", "b")], "k string, t string"), ["k"], ["t"])


def test_a_hot_key_is_spread_over_chunks(spark):
    """Nine of ten rows have one key, yet no chunk holds much more than its share of them."""
    df = spark.range(0, 20000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("key"), "id", (F.col("id") % 1000).cast("double").alias("v"))
    sizes = with_chunks(df, "id", 16).groupBy("key", "_chunk").count().where("key = 'hot'").collect()
    assert len(sizes) == 16
    assert max(r["count"] for r in sizes) < 2 * 18000 / 16


def test_one_value_in_most_rows(spark):
    """Equal values are counted before the ranks, so they do not pile up."""
    df = spark.range(0, 9000).select(F.lit("k").alias("key"), F.when(F.col("id") % 3 < 2, F.lit(0.0)).otherwise(F.col("id").cast("double")).alias("v"))
    row = exact_percentiles(df, ["key"], "v", {"a": 0.5, "b": 0.95}, 8).first()
    exact = df.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95)))).first()[0]
    assert [row.a, row.b] == pytest.approx(exact)
    assert value_ranks(df, ["key"], "v", 8).count() == 3001


def test_null_keys_keep_rows_and_percentiles(spark):
    from runloom.operators.ordering import exact_percentiles, with_position

    rows = [(None, 2.0, 1), (None, 4.0, 2), ("a", 1.0, 3), ("a", 3.0, 4)]
    df = spark.createDataFrame(rows, "k string, x double, t long")
    placed = with_position(df, ["k"], ["t"]).collect()
    assert sorted((r["k"] or "", r["index"]) for r in placed) == [("", 1), ("", 2), ("a", 1), ("a", 2)]
    middle = {r["k"]: r["p50"] for r in exact_percentiles(df, ["k"], "x", {"p50": 0.5}).collect()}
    assert middle == {None: 3.0, "a": 2.0}


def test_unknown_tokens_have_no_efficiency(spark):
    from pyspark.sql import functions as F

    from runloom.operators.metrics import classify_runs

    df = spark.createDataFrame(
        [({"a": "b" * 40}, None, 0.5), ({"a": None}, 1, 0.5), ({"a": "b" * 40}, 10, 0.5)],
        "outputs map<string,string>, tokens_used long, execution_time double",
    )
    rows = classify_runs(df).orderBy(F.col("tokens_used").asc_nulls_first()).collect()
    assert rows[0]["efficiency"] is None and rows[0]["grade"] == "poor"
    assert rows[1]["efficiency"] == 1.0


def test_hot_and_missing_times_are_cut(spark):
    """One leading value and NULL hold most rows of a key; ties and nulls in the second column stay in order."""
    rows = [("hot", None if i % 3 == 0 else 5.0 if i % 3 == 1 else float(i % 7), None if i % 50 == 0 else (i * 37) % 3001) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, v double, id long")
    chunked = with_chunks(df, ["v", "id"], 16)
    assert chunked.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 3 * 3000 / 16
    last = chunked.groupBy("_chunk").agg(F.max(F.struct("v", "id")).alias("last"), F.min(F.struct("v", "id")).alias("first")).orderBy("_chunk").collect()
    key = lambda r: [(x is not None, x or 0) for x in r]  # noqa: E731  null first
    assert all(key(a.last) <= key(b.first) for a, b in zip(last, last[1:]))
    placed = with_position(df, ["key"], ["v", "id"], chunks=16)
    plain = F.row_number().over(Window.partitionBy("key").orderBy("v", "id"))
    wrong = placed.withColumn("plain", plain).where((F.col("index") != F.col("plain")) & F.col("id").isNotNull())
    assert placed.count() == 3000 and wrong.count() == 0


PROBES = {
    "text ties": (lambda i: (5.0, f"exec_{i:05d}", "x"), ["v", "t"]),
    "text ties of missing values": (lambda i: (None, f"exec_{i:05d}", "x"), ["v", "t"]),
    "equal ties": (lambda i: (1.0, "same", f"{i}") if i >= 10 else (float(i), "other", ""), ["v", "t"]),
    "no tie column": (lambda i: (1.0 if i % 4 else 2.0, f"{i}", "x"), ["v"]),
    "missing ties": (lambda i: (1.0, None if i % 2 else f"{i}", f"{i % 50}"), ["v", "t", "u"]),
    "long texts with one beginning": (lambda i: (0.0, "a" * 300 + f"{i:06d}", "x"), ["v", "t"]),
}


@pytest.mark.parametrize("probe", PROBES)
def test_hot_values_are_cut_by_columns_of_any_type(spark, probe):
    make, order = PROBES[probe]
    rows = [("k" if i % 3 else "other", i, *make(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, id long, v double, t string, u string")
    sizes = [r["n"] for r in with_chunks(df, order, 8).groupBy("_chunk").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 3 * 2000 / 8
    placed = with_position(df, ["key"], order, chunks=8)
    rank = F.rank().over(Window.partitionBy("key").orderBy(*order))
    size = F.count("*").over(Window.partitionBy("key", *order))
    # among rows that the order does not tell apart, each place is taken once
    checked = placed.withColumn("low", rank).withColumn("n", size)
    assert checked.where((F.col("index") < F.col("low")) | (F.col("index") >= F.col("low") + F.col("n"))).count() == 0
    assert checked.select("key", "index").distinct().count() == 2000


def test_copies_of_a_whole_row_are_numbered(spark):
    df = spark.createDataFrame([("k", 1, 1.0, "t", "u")] * 700 + [("k", i, 2.0, "t", "u") for i in range(300)], "key string, id long, v double, t string, u string")
    assert sorted(r["index"] for r in with_position(df, ["key"], ["v", "t"], chunks=8).collect()) == list(range(1, 1001))
