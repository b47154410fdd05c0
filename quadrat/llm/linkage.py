"""Matching entities without keys: a deterministic cascade of exact joins on ever weaker combinations.

Attributes are first brought to canonical spellings, which are stored. Each rule is a pass of its own: it joins the
records that are still open to the registry on the rule's attributes, a record is resolved if it meets exactly one
entry, and what is resolved leaves the cascade by an anti join before the next rule. A pair's confidence is the
rule's labelled precision, smoothed. Labels are what evidence that the rule does not use says of all records, not only
of those that come to the rule: their coordinates, or their names for the rule on coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import names
from quadrat.operators.nearby import haversine_m, in_box
from quadrat.sources.tables import cut

# The rules in order: attributes that must be equal, and attributes that may not be known and different.
RULES = (
    (("region", "farm", "place", "number"), ()),
    (("region", "person", "place", "number"), ()),
    (("region", "place", "number"), ()),
    (("farm", "place", "number"), ("region",)),
    (("person", "place", "number"), ("region",)),
    (("place", "number"), ("region", "farm", "person")),
    (("region", "farm", "person", "number"), ("place",)),
    (("region", "cell", "number"), ("place",)),
)
GUARDS = ("region", "farm", "person", "place")
CELL_DEGREES = 0.02
LABEL_M = 2_000.0
BOX = (110.0, 155.0, -45.0, -10.0)


def _cell(spread: bool) -> Column:
    """Cell of a record's coordinates, or all nine around it."""
    x, y = F.floor(F.col("longitude") / CELL_DEGREES), F.floor(F.col("latitude") / CELL_DEGREES)
    one = lambda i, j: F.concat_ws(":", (x + i).cast("string"), (y + j).cast("string"))
    return F.explode(F.array(*[one(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])) if spread else one(0, 0)


def _known(df: DataFrame, attributes: tuple[str, ...], spread: bool) -> DataFrame:
    for c in attributes:
        df = df.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull() if c == "cell" else F.col(c).isNotNull())
    return df.withColumn("cell", _cell(spread)) if "cell" in attributes else df


def _resolve(records: DataFrame, registry: DataFrame, attributes: tuple[str, ...], guards: tuple[str, ...]) -> DataFrame:
    """(rec, reg) of the records that meet exactly one entry on the attributes; of several that of the stated farm kind, if that is one."""
    a = _known(records, attributes, True).select(F.col("id").alias("rec"), *attributes, *[F.col(g).alias(f"a_{g}") for g in guards], F.col("kind").alias("a_kind"))
    b = _known(registry, attributes, False).withColumnRenamed("id", "reg")
    kind = F.col("kind") if "farm" in attributes else F.lit(None).cast("string")
    # one row for each combination of the registry's values, however many entries share it
    b = b.groupBy(*attributes, *[F.col(g).alias(f"g_{g}") for g in guards], kind.alias("g_kind")).agg(F.count(F.lit(1)).alias("n"), F.min("reg").alias("reg"))
    met = a.join(b, [*attributes])
    for g in guards:
        met = met.where(F.col(f"a_{g}").isNull() | F.col(f"g_{g}").isNull() | (F.col(f"a_{g}") == F.col(f"g_{g}")))
    fits = F.col("a_kind") == F.col("g_kind")
    one = met.groupBy("rec").agg(F.sum("n").alias("n"), F.min("reg").alias("reg"), F.sum(F.when(fits, F.col("n"))).alias("fit_n"), F.min(F.when(fits, F.col("reg"))).alias("fit_reg"))
    return one.select("rec", F.when(F.col("n") == 1, F.col("reg")).when(F.col("fit_n") == 1, F.col("fit_reg")).alias("reg")).where("reg is not null")


def prepare(spark: SparkSession, records: DataFrame, registry: DataFrame, rec_id: str, reg_id: str) -> tuple[DataFrame, DataFrame]:
    """Both sides as (id, region, farm, person, place, kind, number, longitude, latitude) with canonical spellings, stored."""
    cols = GUARDS
    pick = lambda df, i: df.select(F.col(i).alias("id"), *[F.col(c).alias(f"t_{c}") for c in cols], "longitude", "latitude").distinct()
    texts = tuple(f"t_{c}" for c in cols)
    base = pick(registry, reg_id)
    reg = cut(names.with_parts(base, base, texts, texts).drop(*texts))
    rec = names.with_parts(pick(records, rec_id), base, texts, texts).drop(*texts)
    rec = names.canonical_parts(spark, cut(rec), reg)
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    rest = ("kind", "number", number("longitude"), number("latitude"))
    return cut(rec.select("id", *cols, *rest)), reg.select("id", *[F.col(f"r_{p}").alias(p) for p in cols], *rest)


def link(spark: SparkSession, records: DataFrame, registry: DataFrame, rec_id: str, reg_id: str, rules: tuple = RULES) -> DataFrame:
    """(rec_id, reg_id, rule_no): each record's one entry of the registry, by the first rule that finds exactly one.

    Both sides have columns region, farm, person, place, longitude and latitude (any may be null) and
    their id. A rule needs all its attributes to be known. Records that no rule resolves, or that
    meet several entries in each, are not in the result. Extra columns are ignored; repeated rows of an id
    must agree in their attributes.
    """
    return cascade(*prepare(spark, records, registry, rec_id, reg_id), rec_id, reg_id, rules)


def cascade(rec: DataFrame, reg: DataFrame, rec_id: str, reg_id: str, rules: tuple = RULES) -> DataFrame:
    """link() for sides that are prepared."""
    out = None
    for no, (attributes, guards) in enumerate(rules, 1):
        still = rec if out is None else rec.join(out.select(F.col("rec").alias("id")), "id", "left_anti")
        found = cut(_resolve(still, reg, attributes, guards).withColumn("rule_no", F.lit(no)))  # the next pass builds on it
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("rec").alias(rec_id), F.col("reg").alias(reg_id), "rule_no")


def labels(rec: DataFrame, reg: DataFrame, by_place: bool) -> DataFrame:
    """(rec, reg): labelled pairs, each record's one entry by coordinates and number, at most LABEL_M away, or else by all of its names and its number."""
    if not by_place:
        return _resolve(rec, reg, ("region", "farm", "person", "place", "number"), ())
    one = _resolve(rec, reg, ("cell", "number"), ())
    at = lambda df, i, n: df.select(F.col("id").alias(i), F.col("longitude").alias(f"x{n}"), F.col("latitude").alias(f"y{n}"))
    both = one.join(at(rec, "rec", 1), "rec").join(at(reg, "reg", 2), "reg")
    placed = in_box(F.col("x1"), F.col("y1"), BOX) & in_box(F.col("x2"), F.col("y2"), BOX)
    return both.where(placed & (haversine_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) <= LABEL_M)).select("rec", "reg")


def precision(rec: DataFrame, reg: DataFrame, rules: tuple = RULES, prior: tuple[float, float] = (4.0, 1.0)) -> DataFrame:
    """(rule_no, n_labelled, n_right, n_wrong, confidence): each rule put to all labelled records, as if no rule had come before.

    Rules on names are labelled by coordinates, those on cells by names, so that no rule labels itself. ``n_labelled`` are
    the labelled records, ``n_right`` and ``n_wrong`` those for which the rule gives the labelled entry or another
    one, and confidence is the share of right ones, smoothed by ``prior`` (hits, misses). Without labels it is the prior's.
    """
    out = None
    known = {w: cut(labels(rec, reg, w)) for w in (True, False)}
    those = {w: rec.join(k.select(F.col("rec").alias("id")), "id", "left_semi") for w, k in known.items()}
    for no, (attributes, guards) in enumerate(rules, 1):
        w = "cell" not in attributes
        said = known[w].join(_resolve(those[w], reg, attributes, guards).withColumnRenamed("reg", "said"), "rec", "left")
        right = F.col("said") == F.col("reg")
        one = cut(said.agg(F.lit(no).alias("rule_no"), F.count(F.lit(1)).alias("n_labelled"), F.count_if(right).alias("n_right"), F.count_if(~right).alias("n_wrong")))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("confidence", (F.col("n_right") + prior[0]) / (F.col("n_right") + F.col("n_wrong") + sum(prior)))


def linked_with_confidence(spark: SparkSession, records: DataFrame, registry: DataFrame, rec_id: str, reg_id: str, rules: tuple = RULES) -> DataFrame:
    """link() with each rule's ``confidence``, ``n_right`` and ``n_wrong``, see precision()."""
    rec, reg = prepare(spark, records, registry, rec_id, reg_id)
    rates = F.broadcast(precision(rec, reg, rules).drop("n_labelled"))  # one row for each rule
    return cascade(rec, reg, rec_id, reg_id, rules).join(rates, "rule_no")
