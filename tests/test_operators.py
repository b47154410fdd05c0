"""Hand-made edge cases of the survey operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.functions.nullsafe import join_ns, not_in, pct_deviation, strict_mean, strict_sum
from quadrat.operators import aggregates, clean, filters, forecast, nearby, panel, quality, response, sampler, sessions, spatial
from quadrat.sources import files
from quadrat.streaming import intake
from tests.conftest import rows

D = dt.date


def test_null_keys_meet_in_every_kind_of_join(spark) -> None:
    a = spark.createDataFrame([(None, 1, "x"), ("k", 2, "y"), ("l", 3, "z")], "farmer string, n int, v string")
    b = spark.createDataFrame([(None, 10, "p"), ("k", 20, "q"), ("m", 30, "r")], "farmer string, n int, w string")
    assert rows(join_ns(a, b, ["farmer"])) == [("k", 2, "y", 20, "q"), (None, 1, "x", 10, "p")]
    assert len(rows(join_ns(a, b, ["farmer"], "left"))) == 3 and join_ns(a, b, ["farmer"]).columns == ["farmer", "n", "v", "n_right", "w"]
    full = join_ns(a.drop("n"), b.drop("n"), ["farmer"], "full")
    assert {r.farmer for r in full.collect()} == {None, "k", "l", "m"} and full.count() == 4
    assert rows(join_ns(a, b, ["farmer"], "left_anti")) == [("l", 3, "z")] and join_ns(a, b, ["farmer"], "left_semi").count() == 2


def test_strict_aggregates_and_division(spark) -> None:
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, v double")
    assert rows(df.groupBy("k").agg(strict_sum(F.col("v")), strict_mean(F.col("v")))) == [("a", None, None), ("b", 6.0, 3.0)]
    one = spark.createDataFrame([(5.0, 0.0), (5.0, None), (5.0, 4.0)], "v double, n double").select(pct_deviation(F.col("v"), F.col("n")).alias("p"))
    assert [r.p for r in one.collect()] == [None, None, 25.0]
    keep = spark.createDataFrame([(None,), ("x",), ("y",)], "s string").where(not_in(F.col("s"), "x"))
    assert [r.s for r in keep.collect()] == [None, "y"]


def test_december_belongs_to_the_next_summer(spark) -> None:
    df = spark.createDataFrame([(D(2019, 11, 30),), (D(2019, 12, 1),), (D(2020, 2, 29),), (None,)], "d date").select(cal.ord_label(cal.season_ord(F.col("d"))).alias("l"), cal.season_ord(F.col("d")).alias("o"))
    assert [(r.l, r.o) for r in df.collect()] == [("Spring-2019", 8079), ("Summer-2020", 8080), ("Summer-2020", 8080), ("", None)]


def test_crop_ladder_and_age(spark) -> None:
    df = spark.createDataFrame([("wheat stubble", "x"), (None, "fallow"), ("barley", None), (None, None)], "k string, s string")
    ladder = [("fallow_stubble", ("fallow", "stubble"), True), ("wheat", ("wheat",), False), ("coarse", ("barley",), False)]
    assert [r[0] for r in df.select(clean.broad_category(F.col("k"), F.col("s"), ladder)).collect()] == ["fallow_stubble", "fallow_stubble", "coarse", None]
    ages = spark.createDataFrame([(None, 40.0, None), ("fence", 40.0, None), (None, None, "Medium"), (None, None, None)], "c string, g double, b string")
    assert [r[0] for r in ages.select(clean.impute_age(F.lit(None).cast("string"), F.col("c"), F.col("g"), F.col("b"), ("fence",))).collect()] == ["young", None, "old", None]


def test_names_blanks_and_wide_columns(spark) -> None:
    df = spark.createDataFrame([(" ", "B", 1)], "`Crop  Stage` string, `crop..type.` string, CropStage int")
    c = clean.clean_names(df)
    assert c.columns == ["cropstage", "crop.type", "cropstage_2"]
    assert clean.columns_like(c, "^crop") == c.columns
    assert rows(clean.blank_to_null(df.toDF("a", "b", "n"))) == [(None, "b", 1)]


def survey(spark, data):
    return spark.createDataFrame(data, "site string, season int, session date, night int, effort double, success double, crop string")


@pytest.mark.parametrize("method", ["highest_effort", "highest_capture", "random"])
@pytest.mark.parametrize(("combine", "same_crop"), [(True, False), (True, True), (False, False)])
def test_resolution_of_repeats(spark, method, combine, same_crop) -> None:
    d1, d2 = D(2020, 3, 1), D(2020, 4, 1)
    df = survey(spark, [
        ("two", 1, d1, 1, 10.0, 1.0, "w"), ("two", 1, d1, 2, 10.0, 1.0, "w"), ("two", 1, d1, 3, 10.0, 1.0, "w"), ("two", 1, d2, 1, 50.0, 0.0, "w"), ("two", 1, d2, 2, 50.0, 1.0, "w"),
        ("mixed", 1, d1, 1, 10.0, 5.0, "w"), ("mixed", 1, d2, 1, 20.0, 1.0, None), ("one", 1, d1, 1, 5.0, 0.0, None), ("empty", 1, None, 1, None, None, None), ("empty", 1, None, 1, None, None, None), ("two", 1, None, 1, None, None, None),
    ])
    out = sessions.resolve_repeats(df, ["site", "season"], "session", "night", "effort", "success", crop="crop", combine=combine, same_crop=same_crop, method=method)
    got = {}
    for r in out.collect():
        got.setdefault(r.site, []).append((r.session, r.night))
    assert got["one"] == [(d1, 1)] and got["empty"] == [(None, 1)]
    assert sorted(n for _, n in got["two"]) == ([1, 2, 3, 4, 5] if combine else [1, 2] if {s for s, _ in got["two"]} == {d2} else [1, 2, 3])
    assert len(got["mixed"]) == (2 if combine and not same_crop else 1)
    if len(got["mixed"]) == 1 and method != "random":
        assert got["mixed"][0][0] == (d2 if method == "highest_effort" else d1)


def test_panels_fill_and_lags(spark) -> None:
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None), ("b", 2, 7.0)], "k string, t int, v double")
    assert [r.v for r in panel.fill_downup(df, ["k"], [F.col("t")], ["v"]).orderBy("k", "t").collect()] == [5.0, 5.0, 5.0, 7.0, 7.0]
    assert [r.v for r in panel.locf(df, ["k", "t"], ["v"]).orderBy("k", "t").collect()] == [5.0, 5.0, 5.0, 5.0, 7.0]
    lagged = panel.lags(df, ["k"], "t", ["v"], 2).where("k = 'a' AND t = 3").head()
    assert (lagged.v_lag1, lagged.v_lag2) == (5.0, None)
    grid = panel.complete_nights(spark.createDataFrame([("a", 1, 2, 1.0), ("b", 2, 1, 2.0)], "s string, t int, n int, v double"), ["s"], "t", "n")
    assert len(rows(grid)) == 6 and grid.where("v IS NOT NULL").count() == 2
    assert panel.season_panel(df.where("false"), ["k"], "t").count() == 0


def test_strict_seasons_need_three_months(spark) -> None:
    data = [("a", 4, m, float(m)) for m in (1, 2, 3)] + [("b", 4, 1, 1.0), ("b", 4, 2, 2.0), ("b", 4, 3, None), ("a", 4, 1, None)]
    out = aggregates.seasonal_strict(spark.createDataFrame(data, "k string, s int, m int, v double"), ["k"], "s", "m", {"total": ("v", "sum")}, order="v")
    assert rows(out) == [("a", 4, 6.0), ("b", 4, None)]
    with pytest.raises(KeyError):
        aggregates.seasonal_strict(out, ["k"], "s", "s", {"x": ("total", "product")})


def test_cut_bins_are_right_closed(spark) -> None:
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 2.1, None)], "x double").select(forecast.cut3(F.col("x"), F.lit(1.0), F.lit(2.0)).alias("l"))
    assert [r.l for r in df.collect()] == ["Low", "Low", "Moderate", "Moderate", "High", None]


def test_best_available_falls_back(spark) -> None:
    df = spark.createDataFrame([("a", 10, 1.0), ("a", 9, 2.0), ("b", 8, 3.0), ("b", 10, None), ("c", 7, 4.0)], "g string, s int, v double")
    assert rows(forecast.best_available(df, "g", "s", "v", 10)) == [("a", 1.0, 10, True), ("b", 3.0, 8, False), ("c", None, None, False)]


def test_sentences(spark) -> None:
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>").select(forecast.sentence_list(F.col("x")).alias("s"))
    assert [r.s for r in df.collect()] == ["", "a", "a and b", "a, b and c"]


def test_response_limits(spark) -> None:
    df = spark.createDataFrame([(5.0, 4.0), (None, 4.0), (0.0, 4.0), (1.0, 0.0), (1.0, None)], "s double, t double")
    b, old = response.beta_response(F.col("s"), F.col("t")), response.beta_response(F.col("s"), F.col("t"), legacy=True)
    got = df.select(b["n_success"].alias("a"), b["mice_prop"].alias("b"), old["n_success"].alias("c")).collect()
    assert [tuple(r) for r in got[:3]] == [(4.0, 0.999, 4.0), (None, None, 4.0), (0.0, 0.001, 0.0)] and got[3].b is None


def test_step_log_and_rules(spark) -> None:
    df = spark.createDataFrame([(1, "a"), (2, None), (3, " "), (None, "b")], "n int, s string")
    log = [(r.step, r.n_before, r.n_removed) for r in filters.step_log(df, [("n>1", F.col("n") > 1), ("s", F.col("s").isNotNull())]).orderBy("step_no").collect()]
    assert log == [("n>1", 4, 2), ("s", 2, 1)]
    rules = [*quality.required(["n"]), *quality.not_blank(["s"]), quality.within("n", 1, 2), quality.domain("s", "A", "b")]
    assert rows(quality.violations(df, F.col("n"), rules)) == [("blank_s", "warning", "3", "s"), ("domain_s", "warning", "3", " "), ("null_n", "error", None, "n"), ("range_n", "error", "3", "3")]
    assert {r.rule_id: r.n_broken for r in quality.summary(df.where("false"), rules).collect()} == {"null_n": 0, "blank_s": 0, "range_n": 0, "domain_s": 0}


def test_cells_buffers_and_hulls(spark) -> None:
    grid = {"xmin": 0.0, "ymax": 10.0, "dx": 1.0, "dy": 1.0, "nrow": 10, "ncol": 10}
    pts = spark.createDataFrame([(1, 0.0, 10.0), (2, 9.5, 0.5), (3, 10.0, 5.0), (4, None, 1.0), (5, 3.0, 7.0)], "id int, x double, y double")
    r, c = spatial.cell_of(F.col("x"), F.col("y"), grid)
    assert [tuple(x) for x in pts.select("id", r, c).collect()] == [(1, 0, 0), (2, 9, 9), (3, None, None), (4, None, None), (5, 3, 3)]
    ring = spatial.buffers(pts.where("id = 1"), "id", "x", "y", 5000.0).head()
    far = spark.createDataFrame([(ring.lons[i], ring.lats[i]) for i in range(64)], "x double, y double").select(nearby.haversine_m(F.lit(0.0), F.lit(10.0), F.col("x"), F.col("y")).alias("d"))
    assert all(abs(x.d - 5000) < 0.01 for x in far.collect()) and ring.lons[0] == ring.lons[-1]
    rng = np.random.default_rng(1)
    inner = [("g", float(x), float(y)) for x, y in rng.uniform(1, 9, (500, 2))]
    hull = spatial.convex_hulls(spark.createDataFrame([*inner, ("g", 0.0, 0.0), ("g", 10.0, 0.0), ("g", 10.0, 10.0), ("g", 0.0, 10.0), ("h", 1.0, 1.0), ("g", None, 1.0)], "k string, x double, y double"), "k", "x", "y")
    assert {r.k: r.n_corners for r in hull.collect()} == {"g": 4, "h": 1}


def test_sampler_is_reproducible_and_bounded(spark) -> None:
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("a", t, None if t == 3 else float(rng.uniform(0.1, 0.4))) for t in range(12)], "s string, t int, v double")
    one, two = (rows(sampler.sample_draws(df, "s", "t", "v", draws=20, burn=20)) for _ in range(2))
    assert one == two and len(one) == 240 and all(0 < r[3] < 1 for r in one)


def test_csv_folder_stream_stages_and_dictionary(spark, tmp_path) -> None:
    contract = (("id", "double", True), ("day", "date", False), ("note", "string", False))
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.csv").write_text("id,day,note\n1,1/2/2020, x \n2,31/2/2020,\n")
    (folder / "deep" / "b.csv").write_text("id,day,note\nx,3/4/2021,y\n")
    (folder / "skip.csv").write_text("id,day,note\n9,1/1/2020,z\n")
    got = rows(files.read_csv_folder(spark, str(folder), contract=contract, exclude=("skip.csv",)).drop("source_path"))
    assert got == sorted([(1.0, D(2020, 2, 1), "x", "a.csv"), (2.0, None, None, "a.csv"), (None, D(2021, 4, 3), "y", "b.csv")], key=repr)
    assert files.find_csv(spark, str(folder)).count() == 3 and files.find_csv(spark, str(tmp_path / "none")).count() == 0
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    take = lambda: intake.run_once(intake.intake_stream(spark, str(folder), contract), out, check)
    for _ in range(2):  # the second run finds nothing new
        take()
        assert spark.read.parquet(out).count() == 4
    (folder / "c.csv").write_text("id,day,note\n7,1/1/2022,n\n")
    take()
    assert spark.read.parquet(out).count() == 5
    store = files.StageStore(spark, str(tmp_path / "stages"))
    make = lambda: spark.range(3)
    for version, made in (("1", ["s"]), ("1", ["s"]), ("2", ["s", "s"])):
        assert store.stage("s", make, version).count() == 3 and store.made == made
    store.stage("t", make, "1", needs=("s",))
    store.stage("s", make, "3")
    store.stage("t", make, "1", needs=("s",))
    assert store.made == ["s", "s", "t", "s", "t"]
    dic = {(r.table_name, r.column_name): (r.scope, r.description, r.n_rows) for r in files.data_dictionary(spark, {"x": spark.range(2), "y": spark.range(3).selectExpr("id", "id AS z")}, {"id": "the id"}).collect()}
    assert dic == {("x", "id"): ("shared", "the id", 2), ("y", "id"): ("shared", "the id", 3), ("y", "z"): ("own", "not yet documented", 3)}


def test_new_rules_of_names_by_date(spark) -> None:
    df = spark.createDataFrame([("p", D(2014, 1, 1)), ("p", D(2015, 1, 1)), ("p", None), ("q", None), (None, None)], "s string, d date")
    rules = spark.createDataFrame([("p", "west", None, D(2015, 1, 1)), ("p", "east", D(2015, 1, 1), None)], "old string, new string, since date, before date")
    assert [r.o for r in clean.rename_by_rules(df, rules, "s", "o", day="d").orderBy(F.col("s").asc_nulls_last(), F.col("d").asc_nulls_last()).collect()] == ["west", "east", "p", "q", None]


def test_clipping_and_cover(spark) -> None:
    sq = lambda a, b: ([a, b, b, a, a], [a, a, b, b, a])
    rings = spark.createDataFrame([(1, *sq(0.0, 4.0)), (2, *sq(10.0, 11.0))], "id int, lons array<double>, lats array<double>")
    half = [(-1.0, -1.0), (2.0, -1.0), (2.0, 9.0), (-1.0, 9.0)]
    cut = spatial.clip_rings(rings, "lons", "lats", half).withColumn("a", spatial.ring_area("lons", "lats")).collect()
    assert [(r.id, r.a, r.lons[0] == r.lons[-1]) for r in cut] == [(1, 8.0, True)]
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 0.0), ("a", None, 0.0), ("b", 0.0, float("nan"))], "k string, x double, y double")
    got = spatial.buffer_cover(pts, "k", "x", "y", 100_000.0, 1.0)
    assert {(r.k, r.row, r.col) for r in got.collect()} == {("a", i, j) for i in (-1, 0) for j in (-1, 0)}
    assert spatial.buffer_cover(pts.where("false"), "k", "x", "y", 1.0, 1.0).count() == 0


def test_model_table_invariants(spark) -> None:
    from quadrat.plans import pipeline

    got = pipeline.model_data(spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in got:
        by.setdefault(r.site_data_id, []).append(r)
    assert len(got) == len({(r.site_data_id, r.season_ord) for r in got}) > 0
    for rs in by.values():
        steps = sorted(r.season_ord for r in rs)
        assert steps == list(range(steps[0], steps[-1] + 1)) and max(r.season_ord for r in rs if r.n_trial is not None) < steps[-1]
        assert sum(r.mice_prop is not None for r in rs) > 1
    assert all(r.mice_prop is None or 0.001 <= r.mice_prop <= 0.999 for r in got)
    assert {r.time for r in got} == set(range(1, len({r.season_ord for r in got}) + 1))
