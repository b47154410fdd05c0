"""Parts of place and person names, and their canonical spellings.

Kinds (creek, station, northern) and what they are shortened to are no list: kinds are the words that many names
of the registry end or begin with, and a word that is none is taken for the kind that it abbreviates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import canonical
from quadrat.sources.tables import cut

KIND_SHARE = 1 / 200  # a kind is in that share of the registry's names at least, so there are 200 at most
# Words beside a surname that are no name.
NO_SURNAME = ("", "family", "and", "sons")


def _letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(_letters(text), " "), lambda w: w != "")


def _region_words(text: Column) -> Column:
    """Words of a region, a part in brackets at its end first: 'Gaidu (Northern)' -> northern, gaidu."""
    return _words(F.regexp_replace(F.lower(F.trim(text)), r"^(.*?)\s*\((\p{L}+)\)\s*$", "$2 $1"))


def kinds_of(registry: DataFrame, word: Column) -> Column:
    """The words that KIND_SHARE of the registry's names have at a place, as one array value; 1 / KIND_SHARE at most."""
    w = registry.select(word.alias("w")).where("w IS NOT NULL").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    least = w.agg(F.sum("n") * KIND_SHARE).scalar()
    return w.where(F.col("n") >= least).agg(F.array_sort(F.collect_list("w"))).scalar()


def _abbreviated(word: Column, kinds: Column) -> Column:
    """The kind that a word is or abbreviates, null if none: its first letter and its other letters in order; of several one that ends alike, then the shorter."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(word, r"(.)", "$1.*"))
    fits = F.filter(kinds, lambda k: (F.length(word) < F.length(k)) & (F.substring(k, 1, 1) == F.substring(word, 1, 1)) & F.regexp_like(k, pattern))
    ranked = F.array_sort(F.transform(fits, lambda k: F.struct((F.right(k, F.lit(1)) != F.right(word, F.lit(1))).alias("a"), (~F.startswith(k, word)).alias("b"), F.length(k).alias("n"), k.alias("k"))))
    longest = F.array_max(F.transform(kinds, lambda k: F.length(k)))
    return F.when(F.array_contains(kinds, word), word).when(F.length(word) < longest, F.get(ranked, F.lit(0))["k"])


def surname(text: Column) -> Column:
    """'jooluo' of 'w jooluo', 'W. Jooluo', 'jooluo, w' or 'jooluo family': the longest word but 'family'."""
    words = F.filter(F.split(_letters(text), " "), lambda w: ~w.isin(*NO_SURNAME))
    return F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def place_number(text: Column) -> Column:
    """The last number in a paddock's name, without leading zeros; null without digits."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(\d+)(?!.*\d)", 1), "^0+(?=.)", ""), F.lit(""))


def with_parts(df: DataFrame, registry: DataFrame, columns: tuple[str, str, str, str], registry_columns: tuple[str, str, str, str]) -> DataFrame:
    """``df`` with the parts that are compared: r_region, r_farm, kind, r_person, r_place, number.

    Columns are those of region, farm, person and place. The first word of a region and the last one of a farm and of a place
    are spelt out if they abbreviate a kind of the registry's; what a place has between its kind and its number
    (no, pdk) is dropped, as are spaces ('zebren ck no 168' -> 'zebrencreek', 168).
    """
    region, farm, person, place = (F.col(c) for c in columns)
    of_region, of_farm, _, of_place = (F.col(c) for c in registry_columns)
    last = lambda words: F.when(F.size(words) > 1, F.element_at(words, -1))
    kinds = {"_kr": kinds_of(registry, F.when(F.size(_region_words(of_region)) > 1, F.get(_region_words(of_region), F.lit(0)))), "_kf": kinds_of(registry, last(_words(of_farm))), "_kp": kinds_of(registry, last(_words(of_place)))}
    out = df.withColumns({"_wr": _region_words(region), "_wf": _words(farm), "_wp": _words(place), **{k: F.coalesce(v, F.array().cast("array<string>")) for k, v in kinds.items()}})
    rest = lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    first = F.get("_wr", F.lit(0))
    region_form = F.array_join(F.concat(F.array(F.coalesce(_abbreviated(first, F.col("_kr")), first)), rest(F.col("_wr"))), " ")
    n = F.size("_wf")
    kind = F.when(n > 1, F.coalesce(_abbreviated(F.element_at("_wf", -1), F.col("_kf")), F.element_at("_wf", -1)))
    name = F.when(n > 1, F.array_join(F.slice("_wf", F.lit(1), n - 1), "")).otherwise(F.get("_wf", F.lit(0)))
    out = out.withColumn("_wp", F.transform("_wp", lambda w, i: F.struct(w.alias("w"), F.when(i > 0, _abbreviated(w, F.col("_kp"))).alias("k"))))
    upto = F.array_max(F.transform("_wp", lambda w, i: F.when(w["k"].isNotNull(), i + 1).otherwise(0)))
    kept = F.when(upto > 0, F.slice("_wp", F.lit(1), upto)).otherwise(F.col("_wp"))
    place_form = F.array_join(F.transform(kept, lambda w: F.coalesce(w["k"], w["w"])), "")
    blank = lambda c: F.nullif(c, F.lit(""))
    return out.select(*[F.col(c) for c in df.columns], F.when(F.size("_wr") > 0, blank(region_form)).alias("r_region"), blank(name).alias("r_farm"), kind.alias("kind"), surname(person).alias("r_person"), blank(place_form).alias("r_place"), place_number(place).alias("number"))


PARTS = ("region", "farm", "person", "place")


def canonical_parts(spark: SparkSession, records: DataFrame, registry: DataFrame) -> DataFrame:
    """``records`` with canonical region, farm, person and place: the registry's nearest spelling, null if there is none.

    Both sides come from with_parts. The vocabulary of each part is mapped by the pigeonhole join of
    ``canonical``; places are looked for among those of their own number. Records then meet the
    vocabulary in equality joins.
    """
    out = records
    block = lambda p: F.concat(F.lit(f"{p}:"), F.coalesce("number", F.lit(""))) if p == "place" else F.lit(p)
    stack = lambda df: df.select(F.inline(F.array(*[F.struct(block(p).alias("field"), F.col(f"r_{p}").alias("value")) for p in PARTS]))).where("value is not null").distinct()
    reference = stack(registry).select("field", F.xxhash64("field", "value").alias("ref_id"), F.col("value").alias("canonical"))
    mapped = canonical.map_values(spark, stack(records), reference, edits=canonical.NAME_EDITS).where("ref_id <> 0").select("field", "value", "ref_id")
    mapped = cut(mapped.join(reference.select("ref_id", "canonical"), "ref_id").drop("ref_id"))
    for p in PARTS:
        side = mapped.where(F.col("field").startswith(p)).select(F.col("field").alias("_b"), F.col("value").alias(f"r_{p}"), F.col("canonical").alias(p))
        out = out.withColumn("_b", block(p)).join(side, ["_b", f"r_{p}"], "left").drop("_b")
    return out
