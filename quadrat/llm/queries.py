"""Queries for the problems of corpora and entities over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.missing import text_missing
from quadrat.llm import canonical, linkage, survivors
from quadrat.sources.tables import cut, table

FIRST_DATE, LAST_DATE = dt.date(2008, 12, 1), dt.date(2025, 11, 30)
TRAPS, VISITS = "data_monitoring_traps_clean", "data_deduplicate_surveys_season"
NIGHT_FIELDS = ["crop_type", "crop_stage", "traps_set", "phantoms", "mice_night", "comments"]
VISIT_FIELDS = ["session_end_date", "season_year_adj", "crop_type", "crop_stage", "traps_set", "number_mice_caught"]


# 2: best record of each duplicate group ----------------------------------------------------------------------


def _nights(spark: SparkSession, d: str, merge: bool = True) -> DataFrame:
    cols = ("record_id", "site_data_id", "trap_type", "date", "source_rank", "entered_at", *NIGHT_FIELDS)
    undated = ~F.coalesce(F.col("date").between(F.lit(FIRST_DATE), F.lit(LAST_DATE)), F.lit(False))
    return survivors.best_of_groups(table(spark, d, TRAPS, *cols), ["site_data_id", "trap_type", "date"], "record_id", NIGHT_FIELDS, "entered_at", "source_rank", alone=undated, merge=merge)


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "site_data", "site_data_id", "region", F.col("site").alias("farm"), F.col("farmer").alias("person"), F.col("subsite").alias("place"), "longitude", "latitude")


def _spread(spellings: DataFrame, known: DataFrame) -> DataFrame:
    """(place_id, site_data_id): ``known``, and for the other places of a spelling the one entry that all its known ones are, if it is one."""
    both = spellings.join(known, "place_id", "left")
    names_ = both.groupBy("name_id").agg(F.min("site_data_id").alias("_a"), F.max("site_data_id").alias("_b"))
    one = names_.where("_a = _b").select("name_id", "_a")
    return both.join(one, "name_id", "left").select("place_id", F.coalesce("site_data_id", "_a").alias("site_data_id")).where("site_data_id is not null")


def _visits(spark: SparkSession, d: str, merge: bool = True) -> DataFrame:
    visits = table(spark, d, VISITS, "survey_id", "region", "farmer", "site", "subsite", "longitude", "latitude", "session_start_date", "source_rank", "entered_at", *VISIT_FIELDS)
    visits = visits.withColumn("complete", survivors.completeness(VISIT_FIELDS)).drop(*([] if merge else VISIT_FIELDS))
    spelt, at = ["region", "site", "farmer", "subsite"], ["longitude", "latitude"]
    hashed = lambda cols: F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])
    visits = visits.withColumns({"name_id": hashed(spelt), "place_id": hashed(spelt + at)})
    spellings = cut(visits.select("place_id", "name_id", "region", F.col("site").alias("farm"), F.col("farmer").alias("person"), F.col("subsite").alias("place"), *at).distinct())
    known = cut(linkage.link(spark, spellings, _registry(spark, d), "place_id", "site_data_id").select("place_id", "site_data_id"))
    known = cut(_spread(spellings.select("place_id", "name_id"), known))  # stored: its size is known when the join of the visits is planned
    visits = visits.join(known, "place_id", "left").withColumn("paddock", F.coalesce("site_data_id", -F.abs("name_id"))).drop(*spelt, *at, "name_id", "place_id", "site_data_id")
    return survivors.best_of_groups(visits, ["paddock"], "survey_id", VISIT_FIELDS, "entered_at", "source_rank", day="session_start_date", max_days=3, complete="complete", merge=merge)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda df, name: df.where("n_records > 1").select(F.lit(name).alias("table_name"), "first_id", "survivor_id")
    dated = _nights(spark, d, False)
    return pick(dated, TRAPS).unionByName(pick(_visits(spark, d, False), VISITS))


def p2_night_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Size, smallest id, best record and size of the skyline of each trap night."""
    return _nights(spark, d, False)


def p2_nights(spark: SparkSession, d: str) -> DataFrame:
    """One merged record for each trap night."""
    return _nights(spark, d)


def p2_visits(spark: SparkSession, d: str) -> DataFrame:
    """One merged record for each visit."""
    return _visits(spark, d)


# 6: free entries to a reference list ---------------------------------------------------------------------------


def _entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(record_id, field, value) of values that are neither missing nor canonical; the reference; the mapping.

    The nights of one visit to a paddock (site_data_id, session) are the context: they have one crop at one stage.
    """
    ref = table(spark, d, "metadata").select(F.col("field_name").alias("field"), "ref_id", F.col("canonical_value").alias("canonical"), "crop_category")
    t = table(spark, d, TRAPS, "record_id", "site_data_id", "session", "crop_type", "crop_stage")
    crop = F.when(~text_missing(F.col("crop_type")), F.struct(F.lit("crop_type").alias("field"), F.col("crop_type").alias("value")))
    stage = F.when(F.col("crop_stage").isNotNull(), F.struct(F.lit("crop_stage").alias("field"), F.col("crop_stage").alias("value")))
    visit = F.when(F.col("site_data_id").isNotNull() & F.col("session").isNotNull(), F.struct("site_data_id", "session"))
    rows = t.select("record_id", visit.alias("context"), F.inline(F.array_compact(F.array(crop, stage))))
    mapped = canonical.map_entries(spark, rows.drop("record_id"), ref.select("field", "ref_id", "canonical"))
    same = F.broadcast(ref.select("field", F.col("canonical").alias("value")))  # metadata is a fixed table of 36 rows
    return rows.drop("context").join(same, ["field", "value"], "left_anti"), ref, mapped


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows, _, mapped = _entries(spark, d)
    return rows.join(mapped.select("field", "value", "ref_id"), ["field", "value"]).select("record_id", F.col("field").alias("field_name"), "ref_id")


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Each free spelling with its entry, category, distance, rule and number of rows; unmatched ones with ref_id 0."""
    rows, ref, mapped = _entries(spark, d)
    n = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    return mapped.join(n, ["field", "value"]).join(F.broadcast(ref.drop("field")), "ref_id", "left").select(F.col("field").alias("field_name"), "value", "ref_id", "canonical", "crop_category", "distance", "rule", "n_rows")


# 7: matching entities without keys -----------------------------------------------------------------------------


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Agency paddocks and the paddock of site_data each is, with the rule that found it and its confidence."""
    agency = table(spark, d, "agency_sites", "agency_site_id", F.col("area_name").alias("region"), F.col("property_name").alias("farm"), F.col("landholder").alias("person"), F.col("paddock").alias("place"), "longitude", "latitude")
    links = linkage.linked_with_confidence(spark, agency, _registry(spark, d), "agency_site_id", "site_data_id")
    return links.select("site_data_id", "agency_site_id", "rule_no", "confidence", "n_right", "n_wrong")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).select("site_data_id", "agency_site_id")


# 8: token ids ------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from quadrat.llm import encode  # loaded where it is needed: the driver stays small

    return encode.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose ids do not decode to their text: none are expected."""
    from quadrat.llm import encode  # loaded where it is needed: the driver stays small

    docs = table(spark, d, "documents", "doc_id", "text")
    back = encode.decode(encode.encode(docs, "doc_id", "text"), "doc_id").withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").where(F.coalesce("text", F.lit("")) != F.col("decoded")).select("doc_id", "text", "decoded")


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of tokens and characters of each document, and where its last token ends."""
    from quadrat.llm import encode  # loaded where it is needed: the driver stays small

    e = encode.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", offsets=True)
    return e.select("doc_id", F.size("ids").alias("n_tokens"), F.element_at(F.concat(F.array(F.lit(0)), "ends"), -1).alias("last_end"))


# 9: evaluation passages ----------------------------------------------------------------------------------------


def _leak_args(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from quadrat.llm import leakage  # loaded where it is needed: the driver stays small

    return leakage.leaked(*_leak_args(spark, d)).select("item_id", "doc_id")


def p9_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    """Items whose templates documents have with other numbers, names or units."""
    from quadrat.llm import leakage  # loaded where it is needed: the driver stays small

    return leakage.reparameterised(*_leak_args(spark, d), "question", "answer")


# 10: wrong encodings --------------------------------------------------------------------------------------------


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from quadrat.llm import garbled  # loaded where it is needed: the driver stays small

    return garbled.damaged_documents(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id")


def p10_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Garbled tokens of the corpus and what they were."""
    from quadrat.llm import garbled  # loaded where it is needed: the driver stays small

    return garbled.damaged_tokens(garbled.vocabulary(table(spark, d, "documents", "text"), "text"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with their original text, as far as it can be had."""
    from quadrat.llm import garbled  # loaded where it is needed: the driver stays small

    return garbled.restored_documents(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_night_survivors, p2_nights, p2_visits, p6_found, p6_values, p7_found, p7_matches, p8_ids, p8_roundtrip, p8_offsets, p9_found, p9_reparameterised, p10_found, p10_tokens, p10_restored)}

_OK = "date BETWEEN DATE '2008-12-01' AND DATE '2025-11-30'"
_N = " + ".join(f"({c} IS NOT NULL)::INT" for c in NIGHT_FIELDS)
_P = " || ".join(f"({c} IS NOT NULL)::INT::VARCHAR" for c in NIGHT_FIELDS)
_WORSE = "(a.n >= b.n AND a.source_rank <= b.source_rank AND a.entered_at >= b.entered_at AND (a.n > b.n OR a.source_rank < b.source_rank OR a.entered_at > b.entered_at))"
# nights: g groups them; r are the records that count, the latest of each trust and pattern of fields; w who is dominated by whom; l the layers
_LAYERS = f"""t AS (SELECT *, {_N} AS n, {_P} AS p, CASE WHEN coalesce({_OK}, false) THEN -1 ELSE record_id END AS own FROM data_monitoring_traps_clean),
  g AS (SELECT *, min(record_id) OVER w AS first_id, count(*) OVER w AS n_records FROM t WINDOW w AS (PARTITION BY site_data_id, trap_type, date, own)),
  r AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY first_id, p, source_rank ORDER BY entered_at DESC, record_id) = 1),
  w AS (SELECT b.first_id, a.record_id AS better, b.record_id FROM r a JOIN r b ON a.first_id = b.first_id AND {_WORSE}),
  x(record_id, l) AS (SELECT record_id, 1 FROM r UNION SELECT w.record_id, x.l + 1 FROM x JOIN w ON w.better = x.record_id),
  l AS (SELECT r.*, m.l FROM r JOIN (SELECT record_id, max(l) AS l FROM x GROUP BY 1) m USING (record_id))"""
_BEST = "ORDER BY l, n DESC, entered_at DESC, source_rank, record_id"
_HEAD = f"site_data_id, trap_type, date, n_records, first_id, first(record_id {_BEST}) AS survivor_id, CAST(count(*) FILTER (l = 1) AS INTEGER) AS n_skyline"
SQL = {
    "p8_roundtrip": "SELECT doc_id, text, text AS decoded FROM documents WHERE false",
    "p2_night_survivors": f"""WITH RECURSIVE {_LAYERS.replace("p, source_rank ORDER", "n, source_rank ORDER")} SELECT {_HEAD} FROM l GROUP BY site_data_id, trap_type, date, n_records, first_id""",
    "p2_nights": f"""WITH RECURSIVE {_LAYERS} SELECT {_HEAD}, {", ".join(f"first({c} {_BEST}) FILTER ({c} IS NOT NULL) AS {c}" for c in NIGHT_FIELDS)} FROM l GROUP BY site_data_id, trap_type, date, n_records, first_id""",
}
