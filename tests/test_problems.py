"""The general data problems on small fixtures: nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import calendar as cal
from quadrat.functions.missing import count_missing, text_missing
from quadrat.operators import impute, nearby, regular_grid, schema_drift
from tests.conftest import rows

DATA = Path("/root/testdata/sf0.1")
KEYS = {"visit": ["site", "visit", "time"], "unit": ["site"], "time": ["time"]}
SCHEMA = "id long, site long, visit int, time int, n double, crop string, n_filled double, _t string, value int"


def survey(spark, data):
    return spark.createDataFrame([(*r, None, "x", 1) for r in data], SCHEMA)


def test_what_counts_as_missing(spark) -> None:
    texts = [None, "", " ", " ", "--", "?", "#N/A", "n.r.", "Unk", "9999", "wheat", "hemp", "not wheat", "nap"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_missing(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [True] * 10 + [False] * 4
    nums = [(None, True), (float("nan"), True), (-1.0, True), (999.0, True), (0.0, False), (100.0, False), (100.5, True)]
    df = spark.createDataFrame([(n,) for n, _ in nums], "n double").select(count_missing(F.col("n")).alias("m"))
    assert [r.m for r in df.collect()] == [m for _, m in nums]


def test_numeric_fill_uses_groups_and_keeps_rows(spark) -> None:
    data = [(i, s, v, s % 2, float(10 * s + v), "wheat") for i, (s, v) in enumerate((s, v) for s in range(4) for v in range(3) for _ in range(5))]
    data += [(1000, 3, 1, 1, None, None), (1001, None, None, None, None, None), (1001, None, None, None, None, None), (1002, 0, 0, 0, float("nan"), "wheat")]
    df = survey(spark, data)
    out = {r.id: r for r in impute.fill_numeric(df, "n", count_missing(F.col("n")), low=0, high=100, **KEYS).collect()}
    got = impute.fill_numeric(df, "n", count_missing(F.col("n")), low=0, high=100, **KEYS)
    assert got.count() == len(data)
    assert set(got.columns) == set(df.columns) | {"n_was_missing", "n_filled"}
    assert out[1000].n_was_missing and abs(out[1000].n_filled - 31) < 3
    assert abs(out[1001].n_filled - np.mean([r[4] for r in data if r[4] == r[4] and r[4] is not None])) < 1e-6
    assert out[1002].n_was_missing and out[1002].n_filled < 5
    assert out[0].n_filled == out[0].n and not out[0].n_was_missing


def test_category_fill_prefers_the_visit_then_wider_levels(spark) -> None:
    data = [(i, 1, 1, 1, 1.0, "wheat") for i in range(5)] + [(i, 1, 2, 1, 1.0, "barley") for i in range(10, 30)] + [(99, 1, 1, 1, 1.0, None), (98, 1, 7, 1, 1.0, "?"), (97, None, None, None, 1.0, ""), (96, 1, 1, 1, 1.0, "hemp")]
    crops = spark.createDataFrame([("wheat",), ("barley",)], "c string")
    out = {r.id: r for r in impute.fill_category(survey(spark, data), "crop", text_missing(F.col("crop")), crops, **KEYS).collect()}
    assert (out[99].crop_filled, out[98].crop_filled, out[97].crop_filled) == ("wheat", "barley", "barley")
    assert out[96].crop_filled == "hemp" and not out[96].crop_was_missing


def test_category_fill_learns_from_other_spellings_and_unlisted_values(spark) -> None:
    data = [(i, 1, 1, 1, 1.0, v) for i, v in enumerate(["Wheat; thin", "WHEAT", "barley"])] + [(i, 2, 2, 1, 1.0, "Hemp ") for i in range(10, 14)] + [(i, 3, 3, 1, 1.0, "korn") for i in range(20, 24)]
    data += [(90, 1, 1, 1, 1.0, None), (91, 2, 2, 1, 1.0, "n/a"), (92, 3, 3, 1, 1.0, "")]
    crops, mapping = spark.createDataFrame([("wheat",), ("barley",), ("maize",)], "c string"), spark.createDataFrame([("korn", "maize"), ("korn", "maize")], "v string, c string")
    out = {r.id: r.crop_filled for r in impute.fill_category(survey(spark, data), "crop", text_missing(F.col("crop")), crops, mapping=mapping, **KEYS).collect()}
    assert (out[90], out[91], out[92], out[10]) == ("wheat", "hemp", "maize", "Hemp ")


def test_effects_are_fitted_jointly(spark) -> None:
    # units are seen at different times, so the means of units and times are confounded: only a joint fit tells them apart
    rng = np.random.default_rng(1)
    unit, time = rng.normal(0, 10, 40), np.linspace(0, 60, 20)
    data = [(i, u, t, t, float(50 + unit[u] + time[t] + rng.normal(0, 1)), "x") for i, (u, t) in enumerate((u, t) for u in range(40) for t in range(20) for _ in range(2) if abs(u / 2 - t) < 6)]
    data += [(9000 + u * 20 + t, u, 100 + t, t, None, "x") for u in range(0, 40, 4) for t in range(20)]
    df = survey(spark, data)
    out = impute.fill_numeric(df, "n", count_missing(F.col("n"), -1e9, 1e9), **KEYS).where("id >= 9000").collect()
    error = np.sqrt(np.mean([(r.n_filled - 50 - unit[r.site] - time[r.time]) ** 2 for r in out]))
    assert len(out) == 200 and error < 2.5


@pytest.mark.skipif(not (DATA.parent / "sf0.01").exists(), reason="no test data")
def test_held_out_values_are_filled_better_than_by_mean_and_mode(spark, capsys) -> None:
    t = spark.read.parquet(str(DATA.parent / "sf0.01" / "data_monitoring_traps_clean.parquet")).select("record_id", "site_data_id", "session", F.year("date").alias("time"), "traps_set", "phantoms", "crop_type").cache()
    keys = {"visit": ["site_data_id", "session", "time"], "unit": ["site_data_id"], "time": ["time"]}
    crops = spark.read.parquet(str(DATA.parent / "sf0.01" / "metadata.parquet")).where("field_name = 'crop_type'").select("canonical_value")
    hidden = F.pmod(F.xxhash64("record_id", F.lit(7)), F.lit(10)) == 0
    lines = []
    for field in ("traps_set", "phantoms"):
        known = t.where(~count_missing(F.col(field))).withColumn("hide", hidden)
        r = impute.fill_numeric(known, field, F.col("hide"), low=0.0, high=100.0, **keys).where("hide")
        mean = known.where("NOT hide").agg(F.avg(field)).head()[0]
        ours, plain = r.agg(F.sqrt(F.avg(F.pow(F.col(field) - F.col(f"{field}_filled"), 2))), F.sqrt(F.avg(F.pow(F.col(field) - mean, 2)))).head()
        lines.append((field, ours, plain))
    known = t.join(crops.withColumnRenamed("canonical_value", "crop_type"), "crop_type").withColumn("hide", hidden)
    r = impute.fill_category(known, "crop_type", F.col("hide"), crops, **keys).where("hide").groupBy("crop_type", "crop_type_filled").count().collect()
    right, every = sum(x["count"] for x in r if x.crop_type == x.crop_type_filled), sum(x["count"] for x in r)
    mode = known.where("NOT hide").groupBy("crop_type").count().orderBy(F.desc("count")).head().crop_type
    plain = sum(x["count"] for x in r if x.crop_type == mode) / every
    with capsys.disabled():
        print("\nheld-out error:", *[f"{f}: {a:.3f}, of the mean {b:.3f};" for f, a, b in lines], f"crop_type: {right / every:.3f} right, of the mode {plain:.3f}")
    assert lines[0][1] < 0.8 * lines[0][2] and lines[1][1] <= 1.02 * lines[1][2] and right / every > max(0.6, plain + 0.2)


def test_fills_of_empty_and_all_missing_tables(spark) -> None:
    crops = spark.createDataFrame([("wheat",)], "c string")
    for data in ([], [(1, 1, 1, 1, None, None)]):
        df = survey(spark, data)
        a = impute.fill_numeric(df, "n", count_missing(F.col("n")), **KEYS).collect()
        b = impute.fill_category(df, "crop", text_missing(F.col("crop")), crops, **KEYS).collect()
        assert len(a) == len(b) == len(data)
        assert all(r.n_filled is None and r.n_was_missing for r in a) and all(r.crop_filled is None for r in b)


def test_regular_grid(spark) -> None:
    data = [("a", 1, 2.0, "z"), ("a", 1, 4.0, "z"), ("a", 4, 9.0, "z"), ("a", 9, None, "z"), ("a", None, 5.0, "z"), ("b", 3, float("nan"), "z"), (None, 1, 1.0, "z"), (None, 3, 3.0, "z")]
    df = spark.createDataFrame(data, "src string, at int, v double, step string")
    got = {(r.src, r.step): r for r in regular_grid.regular_grid(df, ["src"], F.col("at"), F.col("v"), max_gap=3).collect()}
    assert [k[1] for k in sorted(k for k in got if k[0] == "a")] == list(range(1, 10))
    assert (got["a", 1].value, got["a", 1].n_readings, got["a", 1].status) == (3.0, 2, "read")
    assert (got["a", 2].value, got["a", 3].value, got["a", 2].status) == (5.0, 7.0, "filled")
    assert (got["a", 5].value, got["a", 5].status, got["a", 5].prev_step, got["a", 5].next_step) == (None, "gap", 4, 9)
    assert got["b", 3].value is None and got["b", 3].status == "read"
    assert got[None, 2].value == 2.0
    assert regular_grid.regular_grid(df.where("false"), ["src"], F.col("at"), F.col("v")).count() == 0


def test_time_grid_against_brute_force_with_one_hot_source(spark) -> None:
    rng = random.Random(6)
    start = dt.datetime(2024, 5, 1)
    data = [("hot" if i % 3 == 0 else f"s{rng.randrange(8)}", start + dt.timedelta(minutes=rng.randrange(6_000)), rng.choice([None, float("nan"), rng.random(), rng.random(), rng.random()])) for i in range(600)]
    data += [("one", start + dt.timedelta(hours=2), 4.0), ("off", start + dt.timedelta(minutes=7), 4.0), (None, start, 1.0), (None, start + dt.timedelta(hours=3), 4.0), ("hot", None, 1.0), ("one", start + dt.timedelta(hours=2), 6.0)]
    df = spark.createDataFrame([(*r, "x") for r in data], "src string, at timestamp, v double, grid_at string")
    got = {(r.src, r.grid_at): r for r in regular_grid.time_grid(df, ["src"], "at", "1 hour", F.col("v"), max_gap="5 hours").collect()}
    want = {}
    for src in {r[0] for r in data}:
        by: dict = {}
        for _, t, v in (r for r in data if r[0] == src and r[1] is not None and r[2] is not None and r[2] == r[2]):
            by.setdefault(t, []).append(v)
        times = sorted(by)
        mean = {t: sum(v) / len(v) for t, v in by.items()}
        for h in range(120):
            g = start + dt.timedelta(hours=h)
            before, after = [t for t in times if t <= g], [t for t in times if t >= g]
            if before and after:
                a, b = before[-1], after[0]
                near = b - a <= dt.timedelta(hours=5)
                value = mean[a] if a == b else mean[a] + (mean[b] - mean[a]) * ((g - a) / (b - a)) if near else None
                want[src, g] = ("read" if a == b else "filled" if near else "gap", value, sum(len(v) for t, v in by.items() if g <= t < g + dt.timedelta(hours=1)), a, b)
    assert set(got) == set(want) and ("one", start + dt.timedelta(hours=2)) in got and not any(k[0] == "off" for k in got)
    for k, (status, value, n, a, b) in want.items():
        r = got[k]
        assert (r.status, r.n_readings, r.prev_at, r.next_at) == (status, n, a, b) and (r.value is None) == (value is None) and (value is None or abs(r.value - value) < 1e-9)
    assert regular_grid.time_grid(df.where("false"), ["src"], "at", "1 hour", F.col("v")).count() == 0


def test_places_stand_for_many_ids(spark) -> None:
    df = spark.range(3_000).select(F.col("id").alias("pid"), F.when(F.col("id") % 3 == 0, 140.0).otherwise(140.001 + F.floor(F.col("id") / 1000) * 0.1).alias("x"), F.lit(-30.0).alias("y"))
    pairs, members = nearby.near_places(df, "pid", "x", "y", 500.0, (110.0, 155.0, -45.0, -10.0))
    assert [(r.first_place, r.second_place) for r in pairs.collect()] == [(0, 1)] and members.where("place_id = 0").count() == 1_000 and members.count() == 3_000


@pytest.mark.parametrize(("text", "index"), [("DJF", 0), ("Dec-Feb", 0), ("Summ.", 0), ("Autum", 1), ("MAM", 1), ("Wintr", 2), ("Sprng", 3), ("SON", 3), ("", None), (None, None), ("monsoon", None)])
def test_season_spellings(spark, text, index) -> None:
    assert spark.createDataFrame([(text,)], "s string").select(cal.parse_season(F.col("s")).alias("i")).head().i == index


def intake(spark, files):
    f = spark.createDataFrame([(i, 7, no, "x") for i, no, _ in files], "file_id long, feed_id long, file_no int, paths string")
    lines = spark.createDataFrame([(i, n, line, "x") for i, _, ls in files for n, line in enumerate(ls)], "file_id long, line_no int, line string, vals string")
    return f, lines


def test_schema_changes(spark) -> None:
    files = [
        (10, 1, ["Crop.Type,Night,date", "wheat,1,2/3/2020", '"oats, late",2,3/3/2020', '"oats, late",2,3/3/2020']),
        (30, 3, ["date;crop_type;night;phantoms", "2020-03-02;wheat;night 1;2", "2020-03-03;;night 2;"]),
        (20, 2, ["CROP TYPE|night|date", "wheat|1|02 Mar 2020", "oats||03 Mar 2020"]),
        (40, 4, ["trap_date\tcroptypeold\tphantoms", "43892\t18\t", "43893\t19\t2.5"]),
        (50, 5, ["trap_date\tcroptypeold\tphantoms"]),
    ]
    got = rows(schema_drift.schema_changes(*intake(spark, files)))
    want = [
        (30, "added", "phantoms", None, "phantoms"), (30, "retyped", "survey_night", "integer", "text"), (40, "removed", "survey_night", "night", None), (40, "renamed", "capture_date", "date", "trapdate"),
        (40, "renamed", "crop_type", "croptype", "croptypeold"), (40, "retyped", "capture_date", "date", "integer"), (40, "retyped", "crop_type", "text", "integer"), (40, "retyped", "phantoms", "integer", "decimal"),
    ]
    assert got == sorted(want, key=repr)


def feeds(rng, alias):
    """Feeds of files in which the headers of five fields change between names, and of which two come and go."""
    names = {"crop_type": ["crop_type", alias, "Crop"], "phantoms": ["phantoms", "sprung"], "survey_night": ["night"], "site": ["farm", "holding"], "biomass": ["biomass"]}
    value = {"crop_type": lambda: rng.choice(["wheat", "oats"]), "phantoms": lambda: str(rng.randint(0, 9)), "survey_night": lambda: str(rng.randint(1, 4)), "site": lambda: "poobelo", "biomass": lambda: "low"}
    files, want, i = [], set(), 0
    for feed in range(12):
        have = {f: rng.choice(n) for f, n in names.items() if f != "biomass" or feed % 2}
        for no in range(8):
            i += 1
            before = dict(have)
            if no:
                f = rng.choice(list(names))
                if f in have and f in ("biomass", "phantoms") and rng.random() < 0.4:
                    del have[f]
                elif f in have:
                    have[f] = rng.choice(names[f])
                else:
                    have[f] = rng.choice(names[f])
                want |= {(i, "added", g) for g in set(have) - set(before)} | {(i, "removed", g) for g in set(before) - set(have)}
                want |= {(i, "renamed", g) for g in set(have) & set(before) if schema_name(have[g]) != schema_name(before[g])}
            cols = list(have)
            rng.shuffle(cols)
            files.append((i, feed, no, [",".join(have[c] for c in cols)] + [",".join(value[c]() for c in cols) for _ in range(3)]))
    return files, want


def schema_name(header):
    return header.lower().replace("_", "")


def test_headers_that_no_alias_names_are_learned_from_the_files(spark) -> None:
    rng = random.Random(5)
    files, want = feeds(rng, "What grows")
    f = spark.createDataFrame([(i, feed, no) for i, feed, no, _ in files], "file_id long, feed_id long, file_no int")
    lines = spark.createDataFrame([(i, n, line) for i, _, _, ls in files for n, line in enumerate(ls)], "file_id long, line_no int, line string")
    seeds = {"crop_type": ("croptype",), "phantoms": ("phantoms",), "survey_night": ("night",), "site": ("farm",), "biomass": ("biomass",)}
    got = {(r.file_id, r.change_kind, r.field_name) for r in schema_drift.schema_changes(f, lines, seeds).collect()}
    assert got == want and {("renamed", "crop_type"), ("renamed", "site"), ("renamed", "phantoms")} <= {w[1:] for w in want}
    table = schema_drift.unified_table(f, lines, {"crop_type": "text", "site": "text"}, seeds)
    assert {r.crop_type for r in table.collect()} == {"wheat", "oats"} and {r.site for r in table.collect()} == {"poobelo"}


def test_five_aliases_taken_from_the_list_are_found_again(spark) -> None:
    if not DATA.exists():
        pytest.skip("no test data")
    f, lines = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("intake_files", "intake_lines"))
    hidden = {"cropgrown", "paddock", "weight", "trapmodel", "growthstage"}
    fewer = {k: tuple(n for n in v if n not in hidden) for k, v in schema_drift.HEADER_ALIASES.items()}
    key = lambda df: {(r.file_id, r.change_kind, r.field_name, r.before, r.after) for r in df.collect()}
    assert key(schema_drift.schema_changes(f, lines, fewer)) == key(schema_drift.schema_changes(f, lines))


def test_path_values_are_maps(spark) -> None:
    f, lines = intake(spark, [(1, 1, ["Crop;night;crop;crop", "wheat;1;oats", "x;2;y;z;surplus"]), (2, 2, ["a,b"]), (3, 3, [])])
    got = rows(schema_drift.path_values(f, lines))
    assert got == [(1, 1, {"crop": "wheat", "night": "1", "crop#3": "oats", "crop#4": None}), (1, 2, {"crop": "x", "night": "2", "crop#3": "y", "crop#4": "z"})]


@pytest.mark.parametrize(("value", "kind"), [("7", "integer"), ("-07", "integer"), ("+", "text"), ("1-", "text"), ("1.5", "decimal"), (".5e-3", "decimal"), ("1e5", "decimal"), ("1d", "text"), ("2/3/2020", "date"), ("2020-03-02T07:00", "date"), ("02 Mar 2020", "date"), ("Mar 2, 2020", "date"), ("2.3.4", "text"), ("night 1", "text"), (" ", None), (None, None)])
def test_value_kinds(spark, value, kind) -> None:
    assert spark.createDataFrame([(value,)], "v string").select(schema_drift.value_kind(F.col("v")).alias("k")).head().k == kind


def test_unified_table_types_values_and_reports_failures(spark) -> None:
    files = [(1, 1, ["date,night,weight,northing_deg,phantoms", '2/3/2020,night 2,18.5 g,33.5 S,2 sprung', "43892,3,x,-33.5,", "43892,3,x,-33.5,"]), (2, 2, [])]
    fields = {"capture_date": "date", "survey_night": "integer", "weight_g": "decimal", "latitude": "decimal", "phantoms": "integer", "biomass": "text"}
    got = rows(schema_drift.unified_table(*intake(spark, files), fields))
    assert got == [(1, 1, dt.date(2020, 3, 2), 2, 18.5, -33.5, 2, None, []), (1, 2, dt.date(2020, 3, 2), 3, None, -33.5, None, None, ["weight_g"])]
    empty = [df.where("false") for df in intake(spark, files)]
    assert schema_drift.schema_changes(*empty).count() == 0 and schema_drift.unified_table(*empty, fields).count() == 0


def test_split_fields_on_long_and_odd_lines(spark) -> None:
    lines = ["", ",", 'a,"b ""c"", d",', '"' + "x," * 50_000 + '",2', 'un"quoted,1', "x" * 200_000]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select(schema_drift.split_fields(F.col("l"), F.lit(",")).alias("p"))
    got = [r.p for r in df.collect()]
    assert got[:3] == [[""], ["", ""], ["a", 'b "c", d', ""]]
    assert got[3] == ["x," * 50_000, "2"] and got[4] == ['un"quoted', "1"] and len(got[5][0]) == 200_000


def test_near_pairs_against_brute_force(spark) -> None:
    rng = np.random.default_rng(3)
    pts = [(int(i), 140 + float(x), -30 + float(y)) for i, (x, y) in enumerate(rng.uniform(0, 0.05, (150, 2)))]
    pts += [(200, *pts[0][1:]), (201, *pts[0][1:]), (202, None, -30.0), (203, float("nan"), -30.0), (204, 0.0, 0.0), (205, *pts[0][1:]), (205, *pts[0][1:])]
    df = spark.createDataFrame([(*p, 1) for p in pts], "pid long, lon double, lat double, id int")
    box = (110.0, 155.0, -45.0, -10.0)

    def far(a, b):
        p, q = np.radians([a[1:], b[1:]])
        h = np.sin((q[1] - p[1]) / 2) ** 2 + np.cos(p[1]) * np.cos(q[1]) * np.sin((q[0] - p[0]) / 2) ** 2
        return 2 * 6_371_000 * np.arcsin(np.sqrt(h))

    ok = [p for p in pts if p[0] not in (202, 203, 204)]
    want = {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and far(a, b) <= 500}
    got = [(r.first_id, r.second_id) for r in nearby.near_pairs(df, "pid", "lon", "lat", 500.0, box).collect()]
    assert set(got) == want and len(got) == len(want)
    assert nearby.near_pairs(df.where("false"), "pid", "lon", "lat", 500.0, box).count() == 0


def test_containing_region_with_holes_edges_and_pieces(spark) -> None:
    sq = lambda a, b: ([a, b, b, a, a], [a, a, b, b, a])
    rings = spark.createDataFrame([(1, "A", 1, False, *sq(0.0, 10.0)), (2, "A", 1, True, *sq(4.0, 6.0)), (3, "B", 2, False, *sq(4.0, 6.0)), (4, "C", 3, False, *sq(20.0, 30.0))], "ring_id int, zone string, piece int, is_hole boolean, lons array<double>, lats array<double>")
    pts = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 25.0, 25.0), (4, 50.0, 5.0), (5, 10.0, 5.0), (6, 4.0, 5.0), (7, 0.0, 0.0), (8, None, 1.0), (9, float("nan"), 1.0), (10, 5.0, 10.0), (1, 1.0, 1.0)]
    df = spark.createDataFrame([(*p, "q") for p in pts], "pid long, x double, y double, region string")
    got = {r.pid: r.region for r in nearby.containing_region(df, "pid", "x", "y", rings, "zone", "piece", none="none").collect()}
    assert got == {1: "A", 2: "B", 3: "C", 4: "none", 5: "A", 6: "A", 7: "A", 10: "A"}
    assert nearby.containing_region(df, "pid", "x", "y", rings.where("false"), "zone", "piece", none="none").where("region = 'none'").count() == 9
