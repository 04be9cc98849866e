import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.operators import checks, constraints, joins, latest, positions, quantiles, summaries

FRACTIONS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def skewed(spark, n=3000, seed=7):
    """A third of the rows share one key; values repeat, some are null, some negative."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.02 else rng.choice([rng.randint(-50, 50), rng.randint(0, 10**7)])
        rows.append((i, key, value))
    return rows, spark.createDataFrame(rows, "i int, key string, value int").repartition(4)


@pytest.mark.parametrize("operator", [quantiles.grouped_quantiles, quantiles.ranked_quantiles])
def test_quantiles_equal_numpy_per_key(spark, operator):
    rows, df = skewed(spark)
    got = {r.key: r for r in operator(df, ["key"], "value", FRACTIONS, "n").collect()}
    assert set(got) == {"hot", "a", "b", None}
    for key, row in got.items():
        values = [v for _, k, v in rows if k == key and v is not None]
        assert row.n == len(values)
        for name, f in FRACTIONS.items():
            assert row[name] == pytest.approx(np.quantile(values, f), abs=1e-6), (key, name)


@pytest.mark.parametrize("operator", [quantiles.grouped_quantiles, quantiles.ranked_quantiles])
def test_global_quantiles_give_one_row(spark, operator):
    df = spark.createDataFrame([(v * 100_000,) for v in range(1, 9)], "w int")
    row = operator(df, [], "w", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, "n").collect()
    assert [tuple(r) for r in row] == [(275000.0, 450000.0, 625000.0, 8)]
    empty = operator(df.filter("w < 0"), [], "w", {"p25": 0.25, "p50": 0.5}, "n").collect()
    assert [tuple(r) for r in empty] == [(None, None, 0)]


def test_ranked_quantiles_on_doubles_of_any_size(spark):
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 15) for _ in range(500)] + [0.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "w double")
    row = quantiles.ranked_quantiles(df, [], "w", FRACTIONS, "n").first()
    for name, f in FRACTIONS.items():
        assert row[name] == pytest.approx(np.quantile(values, f), rel=1e-9, abs=1e-12)


def test_ranked_quantiles_inside_one_narrow_cell(spark):
    """Values a grid cell cannot tell apart, as fractions and as 64-bit integers."""
    rng = random.Random(5)
    close = [100_000.0 + rng.random() for _ in range(1000)]
    large = [2**50 + rng.randrange(10**6) for _ in range(1000)]
    for values, kind in ((close, "double"), (large, "bigint")):
        df = spark.createDataFrame([(v,) for v in values], f"w {kind}")
        row = quantiles.ranked_quantiles(df, [], "w", FRACTIONS, "n").first()
        for name, f in FRACTIONS.items():
            assert row[name] == pytest.approx(np.quantile(values, f), rel=1e-14)


def test_quantile_over_and_count_over_keep_every_row(spark):
    rows, df = skewed(spark, 400)
    got = quantiles.count_over(df, ["key"], "n").collect()
    assert len(got) == len(rows)
    assert all(r.n == sum(k == r.key for _, k, _ in rows) for r in got)
    medians = quantiles.quantile_over(df, ["key"], "value", {"m": 0.5}).collect()
    assert len(medians) == len(rows)
    for r in medians:
        assert r.m == pytest.approx(np.median([v for _, k, v in rows if k == r.key and v is not None]))


def test_positions_match_row_number(spark):
    rows, df = skewed(spark, 500)
    got = positions.positions_within(df, ["key"], [F.col("value").asc_nulls_first(), F.col("i")], "p").collect()
    assert len(got) == len(rows)
    for key in {k for _, k, _ in rows}:
        mine = sorted((r for r in got if r.key == key), key=lambda r: r.p)
        assert [r.p for r in mine] == list(range(1, len(mine) + 1))
        wanted = sorted(((v if v is not None else -(10**9)), i) for i, k, v in rows if k == key)
        assert [r.i for r in mine] == [i for _, i in wanted]


def test_global_positions_are_dense(spark):
    _, df = skewed(spark, 500)
    got = positions.global_positions(df, [F.col("i").desc()], "p").collect()
    assert sorted(r.p for r in got) == list(range(500))
    assert all(r.i == 499 - r.p for r in got)


def test_bucketed_positions_are_dense(spark):
    rng = random.Random(1)
    firsts = rng.sample(range(10_000), 300)
    df = spark.createDataFrame([(f, f // 1000) for f in firsts], "first int, day int").repartition(3)
    got = positions.bucketed_positions(df, "day", [F.col("first")], "p").collect()
    assert [r["first"] for r in sorted(got, key=lambda r: r.p)] == sorted(firsts)
    assert [r.p for r in sorted(got, key=lambda r: r.p)] == list(range(300))


def test_latest_uses_one_row_per_task_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    kept = latest.latest_per_key(df, "k", [F.col("id").desc()])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    below_the_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below_the_shuffle
    assert sorted(r.id for r in kept.collect()) == list(range(93, 100))


def test_state_paths(spark):
    rows = [
        ("a", "Certified", "2025-01-01", 1, 1), ("a", "Withdrawn", "2025-02-01", 2, 2),
        ("b", "Certified", "2025-03-01", 1, 3), ("b", "Withdrawn", None, 2, 4),
        ("c", "Certified", "2025-01-01", 1, 5),
        ("d", "Certified", "2025-01-01", 1, 6), ("d", "Certified", "2025-01-01", 1, 7),
        # Back to an earlier state on one day: every run is kept, in order.
        ("e", "Certified", "2025-01-01", 1, 8), ("e", "Withdrawn", "2025-01-01", 1, 9),
        ("e", "Certified", "2025-01-01", 1, 10),
        ("f", "Certified", "2025-01-01", 1, 13), ("f", "Denied", "2025-01-01", 1, 11),
        ("f", "Denied", "2025-01-01", 1, 12),
    ]
    df = spark.createDataFrame(rows, "k string, s string, d string, src int, at int")
    order = [F.col("d"), F.col("src"), F.col("at")]
    got = {r.path: r.n for r in latest.state_paths(df, "k", "s", order, "path", "n").collect()}
    assert got == {
        "Certified→Withdrawn": 2, "Certified (x2)": 1, "Certified→Withdrawn→Certified": 1,
        "Denied (x2)→Certified": 1,
    }


def test_rows_of_repeated_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert sorted(r.v for r in latest.rows_of_repeated_keys(df, "k").collect()) == [1, 2]


def test_histogram_leaves_empty_bins_out(spark):
    df = spark.createDataFrame([(95_000,), (99_999,), (100_000,), (250_000,)], "w int")
    got = {r.floor: r.n for r in summaries.histogram(df, "w", 10_000, "floor", "n").collect()}
    assert got == {90_000: 2, 100_000: 1, 250_000: 1}


@pytest.mark.parametrize("bins, cap, beyond", [
    ([(90_000, 400), (100_000, 400), (110_000, 195), (9_000_000, 5)], 110_000, 5),
    ([(90_000, 50), (100_000, 50)], 100_000, 0),
    ([(5, 1)], 5, 0),
])
def test_cumulative_cutoff(spark, bins, cap, beyond):
    df = spark.createDataFrame(bins, "floor int, n int")
    assert [tuple(r) for r in summaries.cumulative_cutoff(df, "floor", "n", 0.995).collect()] == [(cap, beyond)]


def test_cumulative_cutoff_of_nothing_is_nothing(spark):
    df = spark.createDataFrame([], "floor int, n int")
    assert summaries.cumulative_cutoff(df, "floor", "n", 0.995).collect() == []


def test_value_shares_count_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    got = {r.v: (r.n, r.share) for r in summaries.value_shares(df, "v", "n", "share").collect()}
    assert got == {"a": (2, 0.5), "b": (1, 0.25), None: (1, 0.25)}


def test_orphans_and_duplicates(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (9,), (None,)], "id int")
    parent = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert [tuple(r) for r in checks.orphans(child, "id", parent).collect()] == [(9, 2)]
    assert [tuple(r) for r in checks.duplicate_keys(parent, ["id"]).collect()] == [(2, 2)]
    report = checks.orphan_report(child, {"parents": ("id", parent)}).collect()
    assert [tuple(r) for r in report] == [("parents", 1, 2)]


def test_unknown_values_include_null(spark):
    df = spark.createDataFrame([("Year",), ("Fortnight",), (None,)], "u string")
    got = {r.u: r.n_rows for r in checks.unknown_values(df, "u", ["Year", "Hour"]).collect()}
    assert got == {"Fortnight": 1, None: 1}


def test_differing_rows_round_doubles_and_count_copies(spark):
    left = spark.createDataFrame([(1, 0.1 + 0.2), (2, 1.0), (2, 1.0)], "k int, v double")
    right = spark.createDataFrame([(1, 0.3), (2, 1.0)], "k int, v double")
    assert [tuple(r) for r in checks.differing_rows(left, right).collect()] == [(2, 1.0, "left")]
    with pytest.raises(ValueError):
        checks.differing_rows(left, right.drop("v"))


def test_schema_differences(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    expected = T.StructType.fromDDL("a bigint, c string")
    assert checks.schema_differences(df, expected) == ["missing c", "unexpected b", "a is int, not bigint"]


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_wide_integers_are_exact_whatever_their_spread(spark, keys):
    rng = np.random.default_rng(17)
    values = np.concatenate([
        rng.integers(-(2**62), 2**62, 700), rng.integers(0, 50, 900), np.full(400, 7), [2**63 - 1, -(2**63)],
        np.int64(2**55) + rng.integers(0, 3000, 500),
    ]).astype(np.int64)
    rows = [(int(i % 3), int(v)) for i, v in enumerate(values)] + [(0, None), (9, None)]
    df = spark.createDataFrame(rows, "key int, value bigint")
    got = quantiles.ranked_quantiles(df, keys, "value", FRACTIONS, "n").collect()
    for row in got:
        own = sorted(v for k, v in rows if v is not None and (not keys or k == row["key"]))
        assert row["n"] == len(own)
        for name, f in FRACTIONS.items():
            low = int(np.floor(f * (len(own) - 1)))
            a, b = float(own[low]), float(own[min(low + 1, len(own) - 1)])
            assert row[name] == a + (b - a) * (f * (len(own) - 1) - low)
    assert len(got) == (3 if keys else 1)


def test_a_sketch_that_errs_changes_nothing_but_the_work(spark, monkeypatch):
    values = [int(v) for v in np.random.default_rng(3).integers(0, 2**60, 3000)]
    df = spark.createDataFrame([(v,) for v in values], "value bigint")
    wanted = quantiles.ranked_quantiles(df, [], "value", FRACTIONS, "n").first()
    monkeypatch.setattr(quantiles, "_BRACKET", 0.0)
    monkeypatch.setattr(quantiles, "_SKETCH_ALONE", 8)
    assert quantiles.ranked_quantiles(df, [], "value", FRACTIONS, "n").first() == wanted


def test_wide_integers_are_read_without_a_staged_step(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "staged", lambda *_: pytest.fail("staged"))
    df = spark.createDataFrame([(2**40,), (None,)], "value bigint")
    assert quantiles.ranked_quantiles(df, [], "value", {"m": 0.5}, "n").first() == (float(2**40), 1)
    empty = quantiles.ranked_quantiles(df.where("value < 0"), [], "value", {"m": 0.5}, "n").first()
    assert tuple(empty) == (None, 0)


def test_differences_are_one_shuffle_and_keep_copies(spark, monkeypatch):
    monkeypatch.setattr(checks, "_COPIES", 3)
    left = spark.createDataFrame([(1, "a", 0.1)] * 9 + [(2, None, None)] + [(3, "c", float("nan"))], "k int, t string, d double")
    right = spark.createDataFrame([(1, "a", 0.1 + 1e-9)] * 2 + [(2, None, None)] * 5 + [(3, "c", float("nan"))], "k int, t string, d double")
    found = checks.differing_rows(left, right)
    assert sorted((r.k, r.side) for r in found.collect()) == [(1, "left")] * 7 + [(2, "right")] * 4
    plan = checks.differing_rows(left, right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert checks.differing_rows(left, left).count() == 0


def test_constraints_find_what_breaks_them(spark):
    child = spark.createDataFrame([(1, 10), (1, 10), (2, 77), (3, None), (4, 77)], "id int, parent_id int")
    parent = spark.createDataFrame([(10, "x"), (11, "x")], "parent_id int, name string")
    rules = [
        *constraints.not_null("child", ["id", "parent_id"]),
        constraints.Constraint(constraints.UNIQUE, "child", ("id",)),
        constraints.Constraint(constraints.UNIQUE, "parent", ("name",)),
        constraints.Constraint(constraints.REFERENCE, "child", ("parent_id",), "parent"),
    ]
    got = {(r.rule, r.table, r.columns): (r.n_keys, r.n_rows)
           for r in constraints.broken_constraints({"child": child, "parent": parent}, rules).collect()}
    assert got == {
        ("not null", "child", "id"): (0, 0), ("not null", "child", "parent_id"): (1, 1),
        ("unique", "child", "id"): (1, 2), ("unique", "parent", "name"): (1, 2),
        ("reference", "child", "parent_id"): (1, 2),
    }


def test_a_key_with_a_third_of_the_rows_is_spread(spark):
    hot, n = "hot", 3000
    rows = [(i, hot if i % 3 == 0 else f"k{i % 701}", None if i % 50 == 7 else "x") for i in range(n)]
    left = spark.createDataFrame(rows, "serial bigint, name string, place string")
    names = left.select("name", "place").distinct().withColumn("id", F.monotonically_increasing_id())
    found = joins.frequent_values(left, {"name": F.col("name"), "place": F.col("place")}, 0.05)
    assert hot in found["name"] and len(found["name"]) <= 20 and found["place"] == ["x"]
    texts = [joins.key_text([F.lit(hot), F.lit("x")])]
    (key,) = spark.range(1).select(*texts).first()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        sizes = {}
        for frequent in ([], [key]):
            joined = joins.spread_join(left, names, ["name", "place"], frequent, F.col("serial"), 4)
            plain = left.join(names, left.name.eqNullSafe(names.name) & left.place.eqNullSafe(names.place)).count()
            assert joined.where("id is not null").count() == plain == n
            per_task = joined.groupBy(F.spark_partition_id().alias("t")).count().collect()
            sizes[bool(frequent)] = sorted(r["count"] for r in per_task)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes[True]) <= 2 * np.median(sizes[True]) < max(sizes[False]) * 2
    assert max(sizes[False]) > max(sizes[True])
