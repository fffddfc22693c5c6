"""Hand-built rows for rules, edges, models and streams."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars, stats
from weftline.operators import cleaning, marts, models, ordering, ranking, tagging, validation
from weftline.plans import pipeline
from weftline.session import logger, settings
from weftline.sources import readers, sinks
from weftline.streaming import ingest

GOOD = {"trip_id": 1, "trip_key": "a", "tpep_pickup_datetime": "2024-01-05T10:00:00", "tpep_dropoff_datetime": "2024-01-05T10:30:00", "passenger_count": 1, "trip_distance": 2.0, "PULocationID": 5, "DOLocationID": 6, "payment_type": 1, "fare_amount": 10.0, "tip_amount": 2.0, "total_amount": 12.0}


def reasons(spark, *changes):
    lines = [json.dumps(GOOD | c) if isinstance(c, dict) else c for c in changes]
    raw = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    out = validation.validated(ingest.parsed(raw).withColumn("i", F.lit(0)))
    return [r["reject_reason"] for r in out.collect()]


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None), (json.dumps(GOOD)[:60], "corrupt_record"), ({"fare_amount": "not-a-number"}, "corrupt_record"), ({"trip_key": None}, "null_business_identifier"), ({"PULocationID": None}, "null_location"),
        ({"fare_amount": -1.0}, "negative_amount"), ({"fare_amount": None, "total_amount": -1.0}, "negative_amount"), ({"trip_distance": 201.0}, "distance_out_of_range"), ({"trip_distance": 200.0}, None),
        ({"passenger_count": 9}, "passenger_out_of_range"), ({"passenger_count": 8}, None), ({"DOLocationID": 266}, "location_id_out_of_range"), ({"DOLocationID": 265}, None),
        ({"tpep_dropoff_datetime": "2024-01-05T09:00:00"}, "dropoff_before_pickup"), ({"tpep_dropoff_datetime": "2024-01-05T22:00:00"}, None), ({"tpep_dropoff_datetime": "2024-01-05T22:00:01"}, "trip_too_long"),
        ({"tpep_pickup_datetime": "2023-01-05T10:00:00", "tpep_dropoff_datetime": "2023-01-05T10:30:00"}, "out_of_period"), ({"trip_distance": -1.0, "passenger_count": 99}, "distance_out_of_range"), ({"tpep_pickup_datetime": None}, "null_event_time"),
    ],
)
def test_ladder(spark, change, reason):
    assert reasons(spark, change) == [reason]


def test_clean_fills_and_guards(spark):
    raw = spark.createDataFrame([(json.dumps(GOOD | {"passenger_count": None, "fare_amount": 0.0}),)], "value string")
    r = validation.cleaned(ingest.parsed(raw)).first()
    assert (r["passenger_count"], r["RatecodeID"], r["store_and_fwd_flag"], r["airport_fee"], r["tip_pct"], r["year"]) == (1, 99, "N", 0.0, 0.0, 2024)


def test_marts_merge_as_one(spark):
    rows = spark.createDataFrame([("A", "x", 1.0), ("A", "x", None), ("A", "y", 4.0), (None, "x", 9.0)], "k string, b string, v double")
    mart = marts.Mart({"k": F.col("k")}, F.col("k").isNotNull(), {"s": ("v", 2)}, {"m": ("v", 2)})
    whole = mart.of(rows).collect()
    parts = mart.finished(mart.merged(*[mart.partial(rows.filter(F.col("b") == b)) for b in "xy"])).collect()
    assert whole == parts and (whole[0]["trips"], whole[0]["s"], whole[0]["m"]) == (3, 5.0, 2.5)


def test_upsert_and_insert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(marts.upserted(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(marts.inserted(old, new.unionAll(new), ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert "do nothing" in sinks.upsert_sql("t", "s", ["k", "v"], ["k"], update=False)


def test_bins_ties_and_gaps(spark):
    df = spark.createDataFrame([(1, 50.0), (2, 50.0), (3, 0.0), (4, 2000.0), (5, 51.0)], "k int, v double")
    assert [r[0] for r in df.orderBy("k").select(scalars.cut(F.col("v"), [0, 50, 100], ["a", "b"])).collect()] == ["a", "a", None, None, "b"]
    assert df.filter("k = 3").select(scalars.cut(F.col("v"), [0, 50, 100], ["a", "b"], True)).first()[0] == "a"
    r = {x["k"]: x for x in ranking.ranked(df, "v", "k").collect()}
    assert (r[1]["dense_rank"], r[2]["dense_rank"], r[1]["gap"], r[3]["gap"]) == (3, 3, 0.0, 0.0)
    assert abs(r[3]["cumulative_share"] - 100) < 1e-9
    assert {x["q"] for x in ranking.quantile_cut(df.limit(2), "v", ["1", "2", "3", "4"], "q").collect()} == {"1"}


def test_nulls_under_negation(spark):
    df = spark.createDataFrame([(None,), (1,), (9,)], "v int")
    assert df.filter(scalars.negated(F.col("v") < 5)).count() == 2


def test_hours_at_night(spark):
    got = spark.createDataFrame([(5,), (6,), (22,), (23,)], "h int").select(scalars.is_night(F.col("h"))).collect()
    assert [r[0] for r in got] == [True, False, False, True]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k int, v double, c string")
    assert none.agg(F.coalesce(F.try_divide(F.count_if(F.col("v") > 1), F.count("*")), F.lit(0.0)).alias("p")).first()[0] == 0.0
    assert ranking.ranked(none, "v", "k").count() == 0
    assert cleaning.winsorised(none, "v").count() == 0
    assert cleaning.imputed(none, ["v"], ["c"]).count() == 0
    assert stats.classification_report(none.select(F.col("c").alias("t"), F.col("c").alias("p")), "t", "p").count() == 3


def test_class_weights_of_the_toy_labels(spark):
    labels = ["O"] * 5 + ["QTY"] * 3 + ["UNIT"] * 3 + ["ING"]
    got = tagging.class_weights(spark.createDataFrame([(x,) for x in labels], "label string"), boost={"ING": 2.0}).collect()
    assert {r["label"]: round(r["weight"], 6) for r in got} == {"O": 2.4, "QTY": 4.0, "UNIT": 4.0, "ING": 24.0}


def test_token_features(spark):
    rows = tagging.features(tagging.exploded(spark.createDataFrame([(1, ["2", "Cups", "of", "1/2", "Sugar"])], "id int, t array<string>"), "t", "id"))
    r = {x["i"]: x for x in rows.collect()}
    assert r[0]["BOS"] and r[0]["is_digit"] and r[0]["next_is_unit"] and not r[0]["next_is_ingredient"]
    assert r[1]["is_unit"] and r[1]["is_title"] and r[1]["shape"] == "Xxxx" and r[1]["prev_is_digit"]
    assert r[3]["is_fraction"] and r[3]["is_quantity"] and not r[3]["is_numeric"]
    assert r[4]["EOS"] and r[4]["next_is_ingredient"] and r[4]["following_word"] == ""


def test_models_match_closed_forms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2] + [1000, 2, 3]
    y = x @ [2.0, -1.0, 0.5] + 7 + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    m = models.moments(df, ["a", "b", "c"], "y")
    design = np.column_stack([np.ones(200), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    fit = models.ols(m)
    assert np.allclose([fit.intercept, *fit.weights], want, atol=1e-5)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(models.ridge(m, 3.0).weights, np.linalg.solve(xc.T @ xc + 3 * np.eye(3), xc.T @ yc), atol=1e-6)
    w = models.lasso(m, 0.1).weights
    gradient = xc.T @ (yc - xc @ w) / 200
    assert np.all(np.abs(gradient) <= 0.1 + 1e-6)
    r2 = models.metrics(df, "y", fit.predicted()).first()["r2"]
    assert abs(r2 - (1 - ((y - design @ want) ** 2).sum() / (yc**2).sum())) < 1e-5


def test_collinear_features_go(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.pmod(F.xxhash64("id"), F.lit(10)).cast("double").alias("c"), F.col("id").cast("double").alias("y"))
    assert len(models.without_collinear(df, ["a", "b", "c"], "y")) == 2


def test_html_tables(spark):
    html = "<table><tr><th>N</th><th>V</th></tr><tr><td> A  b</td><td>1</td></tr><tr><td>C</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>none")], "id int, html string")
    assert [tuple(r) for r in readers.html_tables(df, "id", "html", ["n", "v"]).collect()] == [(1, 0, "A b", "1"), (1, 1, "C", None)]


def test_file_sources_and_sinks(spark, tmp_path):
    (tmp_path / "z.csv").write_text(" LocationID,Borough ,Zone,service_zone\n1,B,Z,S\nx,B,Z,S\n")
    assert [r[0] for r in readers.zones(spark, str(tmp_path / "z.csv")).collect()] == [1, None]
    (tmp_path / "r.json").write_text('[{"input": "a b", "pos": "x y"}, {"input": "a", "pos": "x y"}]')
    rows = readers.json_array(spark, str(tmp_path / "r.json"), "input string, pos string")
    assert tagging.aligned(tagging.tokenised(rows, "input", "pos"), "input", "pos").count() == 1
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = f"file://{tmp_path}/t"
    sinks.merge_parquet(spark, df, path, ["k"], marts.upserted)
    sinks.merge_parquet(spark, spark.createDataFrame([(2, "c")], "k int, v string"), path, ["k"], marts.upserted)
    assert sorted(spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    assert sinks.markdown(df).startswith("| k | v |")
    sinks.stats(f"{tmp_path}/s.json", {"n": 1})
    assert sinks.stats(f"{tmp_path}/s.json") == {"n": 1} and sinks.stats(f"{tmp_path}/none.json") == {}
    assert readers.with_fallback(lambda: readers.parquet(spark, "/none"), lambda: df).count() == 2


def test_late_rows_are_counted(spark, tmp_path):
    bronze = tmp_path / "bronze"
    bronze.mkdir()
    for i, batch in enumerate(([("a", "00:00"), ("b", "02:00")], [("c", "00:30"), ("b", "02:00")], [("d", "01:00"), ("e", "03:00")])):
        (bronze / f"{i}.json").write_text("".join(json.dumps(GOOD | {"trip_key": k, "tpep_pickup_datetime": f"2024-01-05T{t}:00", "tpep_dropoff_datetime": "2024-01-05T04:00:00"}) + "\n" for k, t in batch))
        import os

        os.utime(bronze / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    raw = readers.text_stream(spark, str(bronze), 1)
    q, bad = ingest.bronze_to_silver(raw, f"{tmp_path}/silver", f"{tmp_path}/quarantine", f"{tmp_path}/checkpoints")
    q.awaitTermination()
    bad.awaitTermination()
    assert sorted(r["trip_key"] for r in spark.read.parquet(f"{tmp_path}/silver").collect()) == ["a", "b", "c", "e"]
    seen = ingest.progress(q)
    assert seen["batches"] == 3 and seen["input_rows"] == 6 and seen["late_rows"] == 1


def test_fault_injection_is_repeatable(spark):
    events = spark.range(2000).select(F.col("id").alias("trip_id"), F.col("id").cast("string").alias("trip_key"), F.lit(5).alias("PULocationID"), F.lit(1.5).alias("fare_amount"))
    out = ingest.injected(events, "trip_key", 0.1, 0.1)
    assert out.count() == ingest.injected(events, "trip_key", 0.1, 0.1).count() > 2200
    assert out.filter(F.col("value").contains("not-a-number")).count() > 0


def test_profiles():
    assert settings("v1")["spark.sql.shuffle.partitions"] == "200" and settings("v2")["spark.sql.shuffle.partitions"] == "8"


@pytest.mark.parametrize("few", [1_000_000, 40])
def test_quantiles_are_exact(spark, few):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=700), np.full(300, 0.25), [5.0, -5.0]])
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None)], "x double, y double")
    got = stats.quantiles(df, {"x": [0.0, 0.013, 0.25, 0.5, 0.77, 1.0], "y": [0.5]}, few)
    assert np.allclose(got["x"], np.quantile(x, [0.0, 0.013, 0.25, 0.5, 0.77, 1.0])) and got["y"] == [None]
    assert stats.quantiles(df.limit(0), {"x": [0.5]}) == {"x": [None]}


def test_a_swap_that_breaks_off_leaves_a_whole_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert not sinks.exists(spark, path)
    sinks.swapped(spark, spark.range(3), path)
    sinks.swapped(spark, spark.read.parquet(path).union(spark.range(1)), path)
    assert spark.read.parquet(path).count() == 4
    sinks.broken_swap(spark, path)
    assert sinks.exists(spark, path) and spark.read.parquet(path).count() == 4


def test_gain_and_windows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 60), (0.0, 2.0, 0), (4.0, None, 12001), (2.0, 1.0, 12000)], "a double, b double, s long")
    got = df.select(scalars.gain(F.col("a"), F.col("b")).alias("up"), scalars.gain(F.col("a"), F.col("b"), False).alias("down"), cleaning.within_minutes(F.col("s")).alias("w"), cleaning.nonzero(["a", "b"]).alias("n")).collect()
    assert [tuple(r) for r in got] == [(100.0, -50.0, True, True), (None, None, False, False), (None, None, False, False), (-50.0, 100.0, True, True)]


@pytest.mark.parametrize("buckets", [1, 7])
def test_order_over_buckets(spark, buckets):
    rng = np.random.default_rng(8)
    x = [float(v) for v in rng.integers(0, 40, 600)] + [7.0] * 400 + [None] * 5
    df = spark.createDataFrame([(v, i) for i, v in enumerate(x)], "x double, i int")
    order = sorted(range(len(x)), key=lambda i: (x[i] is not None, x[i] if x[i] is not None else 0.0, i))
    got = {r["i"]: r["n"] for r in ordering.numbered(df, [F.col("x"), F.col("i")], "n", buckets).collect()}
    assert got == {i: n for n, i in enumerate(order, 1)}
    falling = sorted(range(len(x)), key=lambda i: (x[i] is None, -(x[i] or 0.0), i))
    ranks = {v: r for r, v in enumerate(sorted({v for v in x if v is not None}, reverse=True) + [None], 1)}
    sums = np.cumsum([x[i] or 0.0 for i in falling])
    below = {i: x[j] for i, j in zip(falling, falling[1:] + [None]) if j is not None} | {falling[-1]: None}
    for r in ordering.ranked(df, "x", "i", "x", buckets).collect():
        assert (r["dense_rank"], r["__below"]) == (ranks[r["x"]], below[r["i"]])
        assert r["x"] is None or np.isclose(r["cumulative_share"], sums[falling.index(r["i"])])
    assert ordering.numbered(df.limit(0), [F.col("x")], "n").count() == 0


@pytest.fixture(params=[22, 200])
def many_buckets(spark, request):
    """As many shuffle partitions, and so buckets, as large tables take: 22 and more overflowed an int."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield spark.createDataFrame([(i, float(i * 7 % 40)) for i in range(300)], "i int, x double")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_codes_over_many_buckets(many_buckets):
    assert {(r["x"], r["x_code"]) for r in models.label_encoded(many_buckets, "x").collect()} == {(float(v), v) for v in range(40)}


def test_ranks_over_many_buckets(many_buckets):
    assert {(r["x"], r["dense_rank"]) for r in ranking.ranked(many_buckets, "x", "i").collect()} == {(float(v), 40 - v) for v in range(40)}


def test_numbers_over_many_buckets(many_buckets):
    rows = sorted(many_buckets.collect(), key=lambda r: (r["x"], r["i"]))
    got = {r["i"]: r["n"] for r in ordering.numbered(many_buckets, [F.col("x"), F.col("i")], "n").collect()}
    assert [got[r["i"]] for r in rows] == list(range(1, 301))


def test_models_are_written_and_read(spark, tmp_path):
    model = models.Linear(("a", "b"), 1.5, np.array([0.25, -2.0]))
    models.save_linear(spark, f"file://{tmp_path}/m", model)
    again = models.load_linear(spark, f"file://{tmp_path}/m")
    assert (again.names, again.intercept, again.weights.tolist()) == (("a", "b"), 1.5, [0.25, -2.0])


def _random_chains(rng, width=11, labels=3):
    lengths = np.array([4, 1, 6, 3])
    n = int(lengths.sum())
    return tagging._Chains(rng.integers(0, width, (n, 3)), rng.integers(0, labels, n), rng.random(n) + 0.5, lengths, width, labels)


def test_field_likelihood_and_gradient():
    rng = np.random.default_rng(3)
    c = _random_chains(rng)
    x = rng.normal(size=(11 + 3) * 3)
    w, follows = x[:33].reshape(11, 3), x[33:].reshape(3, 3)
    want = 0.2 * x @ x
    for b, n in zip(c.begins, c.lengths):
        score = w[c.slots[b : b + n]].sum(axis=1)
        total = lambda path: sum(score[t, y] for t, y in enumerate(path)) + sum(follows[p, q] for p, q in zip(path, path[1:]))
        paths = [total(p) for p in itertools.product(range(3), repeat=int(n))]
        want += c.weight[b] * (np.log(np.exp(paths).sum()) - total(c.y[b : b + n].tolist()))
    value, g = c.loss(x, 0.2)
    assert np.isclose(value, want)
    for i in rng.choice(len(x), 12, replace=False):
        d = np.zeros_like(x)
        d[i] = 1e-5
        assert np.isclose(g[i], (c.loss(x + d, 0.2)[0] - c.loss(x - d, 0.2)[0]) / 2e-5, atol=1e-5)


def test_absolute_penalty_is_least_where_conditions_hold():
    c = _random_chains(np.random.default_rng(5))
    x = tagging.least(lambda v: c.loss(v, 0.1), np.zeros(42), 0.4, 500, tolerance=1e-8)
    g = c.loss(x, 0.1)[1]
    assert (x == 0).any() and (x != 0).any()
    assert np.allclose(g[x != 0], -0.4 * np.sign(x[x != 0]), atol=1e-4) and (np.abs(g[x == 0]) <= 0.4 + 1e-4).all()


def test_taggers_are_written_and_read(spark, tmp_path):
    t = tagging.Tagger(("a", "b"), np.eye(4, 2), np.zeros((2, 2)), 4)
    tagging.save_tagger(spark, f"file://{tmp_path}/t", t)
    again = tagging.load_tagger(spark, f"file://{tmp_path}/t")
    assert again.labels == t.labels and np.array_equal(again.weights, t.weights) and again.decode([np.array([0]), np.array([1])]) == ["a", "b"]


def test_supervised_streams_stop_when_idle_and_raise(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny\n")
    raw = readers.text_stream(spark, str(tmp_path / "in"), 1)
    q = ingest.start(raw, "parquet", f"{tmp_path}/out", f"{tmp_path}/c1", every="0 seconds")
    ingest.supervised([q], idle=2.0)
    assert not q.isActive and spark.read.parquet(f"{tmp_path}/out").count() == 2
    good = ingest.start(raw, "parquet", f"{tmp_path}/out2", f"{tmp_path}/c2", every="0 seconds")
    bad = ingest.batches(raw, f"{tmp_path}/c3", lambda batch, number: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision"):
        ingest.supervised([good, bad])
    assert not good.isActive and not bad.isActive


def test_arrivals_take_each_row_once_in_order(spark):
    """Null times, one time of many rows, and an empty table."""
    df = spark.createDataFrame([(i, None if i % 10 == 0 else f"2024-01-{1 + min(i % 29, 20):02d}") for i in range(400)], "i int, d string").select("i", F.to_date("d").alias("pickup"))
    parts = [df.filter(c).collect() for c in pipeline.arrivals(df, 50)]
    assert sorted(r["i"] for part in parts for r in part) == list(range(400))
    times = [[r["pickup"] for r in part if r["pickup"]] for part in parts]
    assert len(parts) > 3 and all(max(a) < min(b) for a, b in itertools.pairwise(times))
    assert all(df.limit(0).filter(c).isEmpty() for c in pipeline.arrivals(df.limit(0), 50))


@pytest.mark.parametrize("name", ["stream_corrupt", "stream_quarantine", "stream_silver"])
def test_streams_of_several_arrivals(spark, folder, tmp_path, monkeypatch, name):
    """The same rows as all at once; lines are gone when they are read, and what stays is compressed."""
    run = getattr(pipeline, name)
    once = sorted(map(str, run(spark, folder).collect()))
    monkeypatch.setattr(pipeline, "ARRIVAL", 2000)
    monkeypatch.setattr(pipeline, "shared", lambda spark, name: str(tmp_path / name))
    assert sorted(map(str, run(spark, folder).collect())) == once
    at = tmp_path / "stream"
    assert not (at / "bronze").exists()
    assert all(f.suffix == ".gz" for f in (at / "quarantine").glob("part-*"))


def test_lakes_are_wiped_and_logs_written(spark, tmp_path):
    path = f"file://{tmp_path}/lake"
    spark.range(2).write.parquet(path)
    assert sinks.wiped(spark, path, f"file://{tmp_path}/none") == [path] and not sinks.exists(spark, path)
    log = logger("test", str(tmp_path / "log.txt"))
    log.info("begun")
    assert logger("test") is log and "begun" in (tmp_path / "log.txt").read_text()


def test_csv_markdown_and_wide_profile(spark):
    df = spark.createDataFrame([(1, None, [1])], "a int, b string, c array<int>")
    assert stats.columns_by_kind(df) == {"numeric": ["a"], "text": ["b"], "time": [], "other": ["c"]}
    assert {r["column"]: (r["n"], r["null_count"], r["n_distinct"]) for r in stats.schema_profile(df).collect()} == {"a": (1, 0, 1), "b": (1, 1, 0), "c": (1, 0, 1)}
