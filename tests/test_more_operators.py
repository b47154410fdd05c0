"""Rapid assessments, rasters, vectors, fetching, places in an order and widened hulls on small fixtures."""

from __future__ import annotations

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import aggregates, clean, panel, rapid, sampler, sessions, spatial
from quadrat.operators.quality import summary
from quadrat.sources import files, rasters, remote, tables
from tests.conftest import rows


def test_transects_need_all_their_segments(spark) -> None:
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, None), (2, 0.0, 0.0, None, None), (3, None, None, None, None)], "id int, a double, b double, c double, d double")
    t = rapid.burrow_measures(rapid.transect_totals(df, ["a", "b", "c", "d"], per=2), ["active_burrows_t1", "active_burrows_t2"])
    got = [(r.id, r.active_burrows_t1, r.active_burrows_t2, r.burrow_transects_searched, r.burrow_transects_present, r.burrow_total_metres, r.burrow_total_count, r.burrow_site_present) for r in t.orderBy("id").collect()]
    assert got == [(1, 3.0, None, 1, 1, 100, 3.0, 1), (2, 0.0, None, 1, 0, 100, 0.0, 0), (3, None, None, None, None, None, None, None)]
    with pytest.raises(ValueError, match="do not make"):
        rapid.transect_totals(df, ["a", "b", "c"], per=2)


def test_methods_are_split_and_lumped_counts_left_out(spark) -> None:
    data = [(1, 1.0, None, None), (1, 1.0, None, None), (2, 2.0, 50.0, rapid.LUMPED + " x"), (3, None, 0.0, None)]
    df = spark.createDataFrame(data, "id int, active_burrows_t1 double, chewcard_percent_1 double, comments string")
    m = rapid.card_measures(rapid.burrow_measures(df, ["active_burrows_t1"]), ["chewcard_percent_1"])
    burrows, cards = rapid.split_methods(m)
    assert [r.id for r in burrows.collect()] == [1] and sorted(r.id for r in cards.collect()) == [2, 3]
    assert not [c for c in burrows.columns if c.startswith("chewcard")] and not [c for c in cards.columns if c.startswith(("active_burrows", "burrow_"))]
    assert rapid.split_methods(m.where("false"))[0].count() == 0
    broken = {r.rule_id: r.n_broken for r in summary(spark.createDataFrame([("2020-01-01", "2020-01-01", 120.0), ("2020-01-09", "2020-01-02", -1.0), ("2020-01-01", "2020-01-09", None), (None, "2020-01-01", 5.0)], "a string, b string, p double").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"), "p"), [*rapid.survey_rules("a", "b"), *rapid.percent_rules(["p"])]).collect()}
    assert broken == {"end_before_start": 1, "long_survey": 1, "same_day": 1, "percent_p": 2}


def test_crop_ages_of_the_ladder(spark) -> None:
    cases = [("fence line", "seedling", "fence", None), ("pasture", "seedling", "grass", "old"), ("wheat", "stubble", "fallow_stubble", "fallow_stubble"), ("canola", "Seeding", "oilseeds", "old"), ("lupins", "seedling", "pulses", "young"), ("hemp", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "k string, s string").withColumn("c", clean.broad_category(F.col("k"), F.lower("s"), clean.crop_ladder()))
    assert [(r.c, r.a) for r in df.withColumn("a", clean.crop_age(F.col("c"), F.col("s"))).collect()] == [c[2:] for c in cases]


def test_rows_are_numbered_bound_and_carried_over_ranges(spark) -> None:
    rng = random.Random(4)
    data = [(i, rng.choice([None, None, float(i)]), "x") for i in range(3_000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "i int, v double, __b string").repartition(7)
    assert [(r.i, r.row_no) for r in panel.numbered(df.drop("__b"), ["i"]).orderBy("i").collect()] == [(i, i + 1) for i in range(3_000)]
    want, last = {}, next(v for _, v, _ in sorted(data) if v is not None)
    for i, v, _ in sorted(data, key=lambda r: r[0]):
        last = v if v is not None else last
        want[i] = last
    assert {r.i: r.v for r in panel.locf(df.drop("__b"), ["i"], ["v"]).collect()} == want
    both = panel.bind_columns(spark.range(5).toDF("i"), spark.range(10, 13).toDF("i"), ["i"], ["i"])
    assert rows(both) == sorted([(0, 10), (1, 11), (2, 12), (3, None), (4, None)], key=repr)
    assert panel.locf(df.drop("__b").where("false"), ["i"], ["v"]).count() == 0


def test_layers_too_far_apart_are_an_error(spark) -> None:
    a, b = (spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.col("id").alias("v")) for n in (20, 18))
    got = aggregates.aligned_layers(a, b, ["k"], "t", {"a": "v", "b": "v"})
    assert got.count() == 18
    with pytest.raises(Exception, match="differ by more than"):
        aggregates.aligned_layers(a, b.limit(3), ["k"], "t", {"a": "v", "b": "v"}).collect()


def test_one_survey_a_month(spark) -> None:
    data = [("a", "2020-01", 5.0, 1.0, 1), ("a", "2020-01", 7.0, 0.0, 2), ("a", "2020-01", 7.0, 2.0, 3), ("a", "2020-02", None, None, 4), (None, "2020-01", 1.0, 1.0, 5), (None, "2020-01", 1.0, 1.0, 6)]
    df = spark.createDataFrame(data, "site string, month string, chewcards_deployed double, chewcards_chewed double, id int")
    assert sorted(r.id for r in sessions.one_survey_a_month(df, "chewcards", "month", "id").collect()) == [3, 4, 5]
    pick = lambda: sorted(r.id for r in sessions.one_survey_a_month(df, "chewcards", "month", "id", method="random", seed="9").collect())
    assert pick() == pick() and len(pick()) == 3
    for kind, method in (("traps", "highest"), ("boats", "highest"), ("chewcards", "best")):
        with pytest.raises(ValueError, match="missing|unknown"):
            sessions.one_survey_a_month(df, kind, "month", "id", method=method)


def test_projection_and_widened_hulls(spark) -> None:
    for lon, lat in ((132.0, -25.0), (115.5, -33.9), (153.2, -12.1)):
        x, y = spatial.to_albers(lon, lat)
        back = spatial.from_albers(x, y)
        assert math.dist(back, (lon, lat)) < 1e-9
    corners = [(140.0, -30.0), (140.0, -31.0), (141.0, -31.0), (141.0, -30.0)]
    df = spark.createDataFrame([("a", *c) for c in corners] + [("a", 140.5, -30.5), ("one", 145.0, -35.0), ("two", 145.0, -35.0), ("two", 146.0, -35.0), (None, 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r for r in spatial.hull_buffers(df, "k", "x", "y", 40_000.0, sides=720).collect()}
    flat = [spatial.to_albers(*c) for c in corners]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(flat, flat[1:] + flat[:1]))) / 2e6
    around = sum(math.dist(a, b) for a, b in zip(flat, flat[1:] + flat[:1])) / 1e3
    assert abs(got["a"].area_km2 - (area + 40 * around + math.pi * 1600)) < 5 and abs(got["one"].area_km2 - math.pi * 1600) < 2
    assert abs(got["two"].area_km2 - (80 * math.dist(spatial.to_albers(145.0, -35.0), spatial.to_albers(146.0, -35.0)) / 1e3 + math.pi * 1600)) < 5
    assert abs(got["a"].centre_lon - 140.5) < 0.01 and abs(got["a"].centre_lat + 30.5) < 0.01 and set(got) == {"a", "one", "two"}
    assert abs(area - 10_580) < 150  # a square degree there, on the ellipsoid


def test_hulls_of_many_points_are_those_of_one_pass(spark) -> None:
    rng = random.Random(2)
    pts = [("a", math.cos(t) * r, math.sin(t) * r) for t, r in ((rng.uniform(0, 7), rng.choice([1.0, rng.random()])) for _ in range(2_000))]
    got = spatial.convex_hulls(spark.createDataFrame(pts, "k string, x double, y double").repartition(9), "k", "x", "y").collect()
    assert len(got) == 1 and set(zip(got[0].lons, got[0].lats)) == set(spatial._hull([p[1:] for p in pts]))


def test_grids_and_collections_are_read(spark, tmp_path) -> None:
    (tmp_path / "a.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner -20\ncellsize 0.5\nNODATA_value -9\n1 2\n-9 4\n")
    (tmp_path / "b.asc").write_text("NCOLS 1\nNROWS 1\nXLLCENTER 0\nYLLCENTER 0\nCELLSIZE 1\n7\n")
    got = rows(rasters.read_ascii_grids(spark, str(tmp_path)))
    assert got == [("a", 0, 0, 10.25, -19.25, 1.0), ("a", 0, 1, 10.75, -19.25, 2.0), ("a", 1, 1, 10.75, -19.75, 4.0), ("b", 0, 0, 0.0, 0.0, 7.0)]
    (tmp_path / "z.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"x","k":2},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]],[[5.1,5.1],[5.2,5.1],[5.2,5.2],[5.1,5.1]]]]}},{"type":"Feature","properties":{},"geometry":null}]}')
    z = rasters.read_geojson(spark, str(tmp_path / "z.json"), "n")
    assert [(r.n, r.piece_no, r.is_hole, len(r.lons)) for r in z.orderBy("piece_no", "is_hole").collect()] == [("x", 1, False, 4), ("x", 2, False, 4), ("x", 2, True, 4)]


def test_fetching_what_is_missing_from_allowed_places(spark, tmp_path) -> None:
    source = tmp_path / "far"
    source.mkdir()
    for y in (2019, 2020):
        (source / f"rain_{y}.nc").write_text(str(y))
    urls = remote.wanted(["rain"], ["rain", "heat"], range(2019, 2021), source.as_uri() + "/{variable}_{year}.nc")
    folder = str(tmp_path / "near")
    assert remote.fetch_missing(spark, urls, folder) == ["rain_2019.nc", "rain_2020.nc"] and remote.fetch_missing(spark, urls, folder) == []
    assert files.drop_newest(spark, folder) == "rain_2020.nc" and remote.fetch_missing(spark, urls, folder) == ["rain_2020.nc"]
    assert (tmp_path / "near" / "rain_2020.nc").read_text() == "2020" and files.drop_newest(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError, match="allowed"):
        remote.wanted(["snow"], ["rain"], range(2020, 2021), "x")
    assert remote.wanted(["snow"], ["rain"], range(2020, 2021), "x", strict=False) == {}
    assert list(remote.months_of(["rain", "snow"], ["rain"], (2019, 12), (2020, 2), "u/{variable}/{year}{month}")) == ["rain_2019_12.nc", "rain_2020_01.nc", "rain_2020_02.nc"]
    with pytest.raises(OSError):
        remote.fetch_missing(spark, {"gone.nc": (source / "gone.nc").as_uri()}, folder)
    assert not (tmp_path / "near" / "gone.nc").exists()


def test_a_cluster_without_a_shared_folder_is_an_error() -> None:
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="shared folder"):
        tables.shared_folder(cluster)


def test_beta_model_finds_the_parameters_it_was_drawn_from() -> None:
    rng = np.random.default_rng(3)
    hits, near = 0, []
    for k in range(6):
        n, x = 80, rng.normal(size=(80, 2))
        a = np.zeros(n)
        for t in range(1, n):
            a[t] = 0.5 * a[t - 1] + rng.normal() * 0.2
        mu = 1 / (1 + np.exp(-(-1.0 + 0.8 * x[:, 0] + a)))
        y = rng.beta(mu * 10, (1 - mu) * 10)
        y[rng.random(n) < 0.2] = np.nan
        means, params = sampler.fit_beta_series(y, x, 400, 400, k)
        lo, hi = np.quantile(means, [0.025, 0.975], axis=0)
        hits += int(((lo <= mu) & (mu <= hi)).sum())
        near.append(params.mean(0))
    phi, ar1, sigma, mean, b0, b1 = np.mean(near, axis=0)
    assert hits >= 0.85 * 6 * 80 and abs(b0 - 0.8) < 0.15 and abs(b1) < 0.15 and abs(mean + 1) < 0.3 and 5 < phi < 20 and -0.2 < ar1 < 0.9 and 0.02 < sigma < 0.6


def test_log_gamma_and_priors() -> None:
    x = np.array([1e-4, 0.3, 1.0, 2.5, 40.0, 1e4])
    assert np.allclose(sampler._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    p = sampler.Priors()
    assert p.log(-1, 0, 1) == p.log(1, 1, 1) == p.log(1, 0, 0) == -np.inf and np.isfinite(p.log(4, 0.3, 0.2))


def test_forecasts_go_past_the_last_step_and_are_saved(spark, tmp_path) -> None:
    rng = np.random.default_rng(0)
    data = [(k, t, None if t == 3 else float(rng.uniform(0.1, 0.4)), float(t % 4 == 0)) for k in ("a", "b") for t in range(12) if t != 7] + [(None, 1, 0.5, 0.0), ("a", None, 0.5, 0.0), ("c", 5, None, None)]
    df = spark.createDataFrame(data, "s string, t int, v double, x double")
    make = lambda: sampler.beta_forecast(df, "s", "t", "v", ["x"], draws=20, burn=20)
    one, two = rows(make()), rows(make())
    assert one == two and {r[0] for r in one} == {"a", "b", "c"} and len(one) == 20 * (14 + 14 + 3) and all(0 < r[3] < 1 for r in one)
    assert {r[2] for r in one if r[4] and r[0] == "a"} == {12, 13} and make().where("false").count() == 0
    s = sampler.save_model(make(), str(tmp_path / "model"), "s").collect()
    assert {(r.s, r.n_draws, r.n_times) for r in s} == {("a", 20, 14), ("b", 20, 14), ("c", 20, 3)} and spark.read.parquet(str(tmp_path / "model" / "draws")).count() == len(one)
    assert sampler.beta_forecast(df.where("false"), "s", "t", "v", ["x"], draws=5, burn=5).count() == 0


def test_cells_of_polygons_and_their_overlay(spark) -> None:
    sq = lambda a, b: ([a, b, b, a, a], [a, a, b, b, a])
    rings = spark.createDataFrame([("A", 1, *sq(0.0, 10.0)), ("A", 1, *sq(4.0, 6.0)), ("B", 1, *sq(5.0, 7.0)), ("T", 1, [0.0, 4.0, 0.0, 0.0], [0.0, 0.0, 4.0, 0.0])], "zone string, piece int, lons array<double>, lats array<double>")
    cells = spatial.polygon_cells(rings, "zone", "piece", 1.0)
    n = {r.zone: r["count"] for r in cells.groupBy("zone").count().collect()}
    assert n == {"A": 96, "B": 4, "T": 6}
    a, b = cells.where("zone = 'A'"), cells.where("zone = 'B'").withColumnRenamed("zone", "other")
    assert (spatial.overlay(a, b, "intersection").count(), spatial.overlay(a, b, "union").count(), spatial.overlay(a, b, "difference").count()) == (3, 97, 93)
    assert spatial.polygon_cells(rings.where("false"), "zone", "piece", 1.0).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        spatial.overlay(a, b, "xor")
