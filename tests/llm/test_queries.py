"""The registered queries of this subpackage over the smallest tables."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import pytest

from quadrat.llm import queries
from tests.conftest import rows

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {
    "p2_found": {"table_name", "first_id", "survivor_id"}, "p6_found": {"record_id", "field_name", "ref_id"}, "p7_found": {"site_data_id", "agency_site_id"},
    "p8_ids": {"doc_id", "ids"}, "p9_found": {"item_id", "doc_id"}, "p10_found": {"doc_id"},
}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_uniqueness(spark, name) -> None:
    df = queries.QUERIES[name](spark, str(DATA))
    assert set(df.columns) == COLUMNS[name]
    got = df.collect()
    assert got and len(got) == len({repr(r) for r in got})


def test_every_free_entry_is_reported_once(spark) -> None:
    got = rows(queries.p6_found(spark, str(DATA)).groupBy("field_name").count())
    want = duckdb.sql(f"""WITH m AS (SELECT * FROM '{DATA}/metadata.parquet') SELECT 'crop_stage', count(*) FROM '{DATA}/data_monitoring_traps_clean.parquet' WHERE crop_stage IS NOT NULL AND crop_stage NOT IN (SELECT canonical_value FROM m WHERE field_name = 'crop_stage')""").fetchall()
    assert want[0] in got


def test_an_agency_row_has_one_partner(spark) -> None:
    got = queries.p7_matches(spark, str(DATA)).collect()
    assert len({r.agency_site_id for r in got}) == len(got) and all(0 < r.confidence < 1 for r in got)


def test_ids_decode_to_the_texts(spark) -> None:
    assert queries.p8_roundtrip(spark, str(DATA)).count() == 0


@pytest.mark.parametrize("name", list(queries.SQL))
def test_matches_sql(spark, name) -> None:
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(queries.SQL[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(DATA)).select(*cols)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))  # as text: NaN is NaN


def test_visits_are_linked_by_the_whole_cascade(spark, tmp_path) -> None:
    registry = [
        (1, "northern gaidu mallee", "poobelo station", "h radrana", "zebren creek 168", 140.0, -30.0),
        (2, "lower cooyecka", "kidimo park", "w noochalong", "reedimell ridge 381", 150.0, -35.0),
        (3, "lower cooyecka", "stazai vale", "r codriell", "reedimell ridge 381", 151.0, -35.0),
    ]
    spark.createDataFrame(registry, "site_data_id long, region string, site string, farmer string, subsite string, longitude double, latitude double").write.parquet(f"{tmp_path}/site_data.parquet")
    spelt = [
        ("northern gaidu mallee", "poobelo station", "h radrana", "zebren creek 168", None, None),
        ("northern gaidu mallee", "poobelo station", "h radrana", "wuvuxqatt 168", None, None),  # the rule without place
        ("northern gaidu mallee", None, None, "hoppulmirt 168", 140.0, -30.0),  # the rule of cells
        ("northern gaidu mallee", None, None, "hoppulmirt 168", None, None),  # its spelling elsewhere
        ("lower cooyecka", "kidimo park", "w noochalong", "reedimell ridge 381", None, None),
        ("lower cooyecka", None, "noochalong, w", "reedimell ridge 381", None, None),  # only the holder decides
        ("lower cooyecka", None, None, "reedimell ridge 381", None, None),  # open: two entries
    ]
    cols = "survey_id long, region string, site string, farmer string, subsite string, longitude double, latitude double, session_start_date date, source_rank int, entered_at timestamp, session_end_date date, season_year_adj string, crop_type string, crop_stage string, traps_set double, number_mice_caught double"
    day = dt.date(2020, 1, 1)
    spark.createDataFrame([(i, *r, day, 1, dt.datetime(2020, 1, 9), day, "Su_2020", None, None, 1.0, 1.0) for i, r in enumerate(spelt, 1)], cols).write.parquet(f"{tmp_path}/{queries.VISITS}.parquet")
    got = {(r.first_id, r.n_records) for r in queries.p2_visits(spark, str(tmp_path)).collect()}
    assert got == {(1, 4), (5, 2), (7, 1)}
