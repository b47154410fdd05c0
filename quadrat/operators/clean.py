"""Projection, renaming, recoding and repair of survey columns. Rules are data, given by the caller."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.nullsafe import is_in, join_ns


def clean_names(df: DataFrame) -> DataFrame:
    """Column names in small letters without spaces, runs of dots as one, none at the ends; clashes get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = re.sub(r"\.+", ".", re.sub(r"\s+", "", c.lower())).strip(".")
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def blank_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns in small letters, blanks as null."""
    cols = columns or [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.nullif(F.lower(F.trim(c)), F.lit("")) for c in cols})


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names that match a pattern, in order."""
    return [c for c in df.columns if re.search(pattern, c)]


def recode(c: Column, labels: dict, junk: tuple = ()) -> Column:
    """Label of a code; unknown codes pass through as text, junk codes and nulls are null."""
    table = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (str(k), v)])
    text = c.cast("string")
    return F.when(~is_in(text, *[str(j) for j in junk]), F.coalesce(F.try_element_at(table, text), text))


def rule_ladder(rules: list[tuple[Column, str]], default: Column | None = None) -> Column:
    """Value of the first rule that holds; a null condition does not hold."""
    out = reduce(lambda acc, r: F.when(r[0], r[1]) if acc is None else acc.when(r[0], r[1]), rules, None)
    return out.otherwise(default) if default is not None else out


def words_match(c: Column, *words: str) -> Column:
    return c.rlike("|".join(words))


def rename_by_rules(df: DataFrame, rules: DataFrame, key: str, out: str, *, day: str | None = None) -> DataFrame:
    """``out``: the new name of ``key`` by a table (old, new[, since, before]); names without a rule stay.

    With ``day`` a rule holds from ``since`` (included) to ``before`` (not included); null bounds are open, and a
    null day meets only rules open on both sides. At most one rule may hold for a row; else the smallest new name is taken.
    """
    r = rules.select(F.col("old").alias("__old"), F.col("new").alias("__new"), *([F.col("since").alias("__s"), F.col("before").alias("__b")] if day else []))
    if day is None:
        one = r.groupBy("__old").agg(F.min("__new").alias("__new"))
    else:
        one = r.groupBy("__old").agg(F.collect_list(F.struct("__new", "__s", "__b")).alias("__r"))
    j = df.join(one, F.col(key) == F.col("__old"), "left")
    if day is None:
        return j.withColumn(out, F.coalesce("__new", key)).drop("__old", "__new")
    d = F.col(day)
    ok = F.filter("__r", lambda x: (x["__s"].isNull() | F.coalesce(d >= x["__s"], F.lit(False))) & (x["__b"].isNull() | F.coalesce(d < x["__b"], F.lit(False))))
    return j.withColumn(out, F.coalesce(F.array_min(F.transform(ok, lambda x: x["__new"])), F.col(key))).drop("__old", "__r")


def backfill_coordinates(df: DataFrame, keys: list[str], changed: Column, lon: str, lat: str) -> DataFrame:
    """Coordinates of changed rows from the mean of the distinct coordinates of the unchanged rows of the same keys."""
    d = df.withColumn("__c", F.coalesce(changed, F.lit(False)))
    side = d.where(~F.col("__c")).select(*keys, lon, lat).distinct().groupBy(*keys).agg(F.avg(lon).alias("__x"), F.avg(lat).alias("__y"))
    j = join_ns(d, side, keys, "left")
    pick = lambda new, old: F.when(F.col("__c"), F.coalesce(new, old)).otherwise(F.col(old))
    return j.withColumns({lon: pick("__x", lon), lat: pick("__y", lat)}).drop("__c", "__x", "__y")


def coordinates_from_history(df: DataFrame, history: DataFrame, key: Column, history_key: Column, stale: Column, order: str, lon: str, lat: str) -> DataFrame:
    """Coordinates of stale rows replaced by those of the first stored row (by ``order``) of the same normalised key."""
    h = history.select(history_key.alias("__k"), F.struct(F.col(lon).alias("x"), F.col(lat).alias("y")).alias("__p"), F.col(order).alias("__o"))
    h = h.groupBy("__k").agg(F.min_by("__p", "__o").alias("__p"))
    j = df.withColumn("__k", key).join(h, "__k", "left")
    hit = F.coalesce(stale, F.lit(False)) & F.col("__p").isNotNull()
    return j.withColumns({lon: F.when(hit, F.col("__p.x")).otherwise(F.col(lon)), lat: F.when(hit, F.col("__p.y")).otherwise(F.col(lat)), "was_fixed": hit}).drop("__k", "__p")


def canonical_coordinates(df: DataFrame, keys: list[str], lon: str, lat: str) -> DataFrame:
    """Coordinates averaged over the keys; rows of keys with a single pair of coordinates keep them as they are."""
    side = df.groupBy(*keys).agg(F.avg(lon).alias("__x"), F.avg(lat).alias("__y"), ((F.min(lon) != F.max(lon)) | (F.min(lat) != F.max(lat))).alias("__m"))
    j = join_ns(df, side, keys, "left")
    many = F.coalesce("__m", F.lit(False))
    return j.withColumns({lon: F.when(many, F.col("__x")).otherwise(F.col(lon)), lat: F.when(many, F.col("__y")).otherwise(F.col(lat))}).drop("__x", "__y", "__m")


def broad_category(kind: Column, stage: Column, ladder: list[tuple[str, tuple[str, ...], bool]]) -> Column:
    """Category of the first rule (name, words, also look in the stage) whose words are in the type or stage; null if none."""
    return rule_ladder([(F.coalesce(words_match(kind, *w), F.lit(False)) | (F.coalesce(words_match(stage, *w), F.lit(False)) if both else F.lit(False)), name) for name, w, both in ladder])


def impute_age(age: Column, category: Column, cover: Column, biomass: Column, never: tuple[str, ...]) -> Column:
    """Age where it is null and the category is none of ``never`` (a null category is eligible): low biomass or cover under 50 young, else old."""
    b = F.lower(biomass)
    guess = F.when((b == "low") | (cover < 50), "young").when(b.isin("medium", "high") | (cover >= 50), "old")
    return F.coalesce(age, F.when(~is_in(category, *never), guess))


def joined_notes(*parts: Column, sep: str = "; ") -> Column:
    """Non-blank notes joined; null if there is none."""
    return F.nullif(F.concat_ws(sep, *[F.nullif(F.trim(p), F.lit("")) for p in parts]), F.lit(""))


def functional_effort(placed: Column, lost: Column) -> Column:
    """Effort less the lost part, a null loss counting as none."""
    return placed - F.coalesce(lost, F.lit(0))


def wide_measures(df: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One column for each listed name, first value by order of value (smallest); names are fixed beforehand, so there is one pass."""
    return df.groupBy(*key).agg(*[F.min(F.when(F.col(name) == n, F.col(value))).alias(f"{n}") for n in names])


# The words of broad crop categories in their order of priority, and of young and old stages.
FALLOW_STUBBLE = ("fallow", "stubble", "plough", "mulch")
CROP_WORDS = (
    ("fallow_stubble", FALLOW_STUBBLE),
    ("wheat", ("wheat",)),
    ("coarse_grains", ("barley", "oats", "sorghum", "maize", "millet", "rye", "ryecorn", "triticale", "cereal", "grain_crop", "cereal unknown", "canary")),
    ("pulses", ("lentils", "lupins", "vetch", "lucerne", "bean", "pea")),
    ("oilseeds", ("canola", "sunflower", "safflower", "linseed")),
    ("fence", ("fence",)),
    ("grass", ("pasture", "verge", "grass")),
)
YOUNG_STAGES = ("tillering", "seedling", "young")
OLD_STAGES = ("seeding", "ripe", "old", "grain", "in head", "flowering", "mature")


def crop_ladder(*, wheat_is_fallow: bool = False) -> list[tuple[str, tuple[str, ...], bool]]:
    """Rules of broad_category for CROP_WORDS, the first of which looks in the stage too.

    With ``wheat_is_fallow`` the first rule takes wheat as well, so that wheat is never given: the form that a later definition of
    the same name has.
    """
    rules = [(name, words, name == "fallow_stubble") for name, words in CROP_WORDS]
    return [(rules[0][0], (*rules[0][1], "wheat"), True), *rules[1:]] if wheat_is_fallow else rules


def crop_age(category: Column, stage: Column) -> Column:
    """Age class of a crop: none for a fence, old for grass, else by words of the stage."""
    s = F.lower(stage)
    some = lambda words: F.coalesce(words_match(s, *words), F.lit(False))
    return F.when(category == "fence", None).when(category == "grass", "old").when(some(FALLOW_STUBBLE), "fallow_stubble").when(some(YOUNG_STAGES), "young").when(some(OLD_STAGES), "old")


def recoded_again(own: Column, source: Column, labels: dict) -> Column:
    """A column derived from another one that is recoded already: where ``source`` still holds a code its label, else ``own``.

    Codes that the first recoding has turned to labels cannot occur any more, so the column passes through.
    """
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in labels.items() for x in (str(k), v)]), source.cast("string")), own)


def merged_zones(name: Column, merged: dict[str, tuple[str, ...]]) -> Column:
    """Zone names with slashes as spaces, and the zones that are merged under their common name."""
    n = F.regexp_replace(name, "/", " ")
    for new, old in merged.items():
        n = F.when(is_in(n, *old), new).otherwise(n)
    return n


def crop_from_comment(crop: Column, comment: Column, words: tuple[str, ...]) -> Column:
    """The crop, or where it is null the first of the listed words that the comment holds."""
    return F.coalesce(crop, rule_ladder([(F.coalesce(F.lower(comment).rlike(rf"\b{w}\b"), F.lit(False)), w) for w in words]))


def type_and_stage(crop: Column, stage: Column) -> Column:
    """'type_stage', the part that is known, or null."""
    return F.nullif(F.concat_ws("_", crop, stage), F.lit(""))


def trap_group(trap: Column, boxes: tuple[str, ...] = ("longworth", "elliott"), dropped: tuple[str, ...] = ("snapback",)) -> Column:
    """'box_trap' for box traps, null for dropped kinds, else the kind in small letters."""
    t = F.lower(trap)
    return F.when(is_in(t, *boxes), "box_trap").when(~is_in(t, *dropped), t)
