"""Sessions of repeated surveys: bounds, numbering, chaining, selection and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.nullsafe import join_ns


def session_bounds(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """``df`` with session_start, session_end, session_length (days, both ends counted) and night (1 is the first day)."""
    g = df.groupBy(*keys).agg(F.min(day).alias("session_start"), F.max(day).alias("session_end"))
    j = join_ns(df, g, keys, "left")
    return j.withColumns({"session_length": F.datediff("session_end", "session_start") + 1, "night": F.datediff(F.col(day), F.col("session_start")) + 1})


def renumber(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Dense number of ``order`` within the keys, ranked over its distinct values."""
    d = df.select(*keys, order).where(F.col(order).isNotNull()).distinct()
    d = d.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return join_ns(df, d, [*keys, order], "left")


def session_summary(df: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """``df`` with counts of its session's rows that meet conditions, nulls not meeting them."""
    g = df.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])
    return join_ns(df, g, keys, "left")


def chain_nights(df: DataFrame, keys: list[str], session: str, night: str) -> DataFrame:
    """Night numbers that run on over the sessions of the keys: each session starts after the longest of those before."""
    s = df.groupBy(*keys, session).agg(F.max(night).alias("__m"))
    before = Window.partitionBy(*keys).orderBy(session).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__o", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    return join_ns(df, s, [*keys, session], "left").withColumn(night, (F.col(night) + F.col("__o")).cast("int")).drop("__o")


def best_session(df: DataFrame, keys: list[str], session: str, effort: str, success: str, method: str = "highest_effort", seed: str = "1") -> DataFrame:
    """(keys, session) of the one session each key keeps.

    highest_effort: most effort, then most success; highest_capture: highest success for effort (none without
    effort, last); random: the first by the md5 of key, session and seed. Remaining ties go to the earliest session.
    """
    s = df.groupBy(*keys, session).agg(F.sum(effort).alias("__e"), F.sum(success).alias("__s"))
    order = {
        "highest_effort": [F.col("__e").desc_nulls_last(), F.col("__s").desc_nulls_last()],
        "highest_capture": [F.when(F.col("__e") > 0, F.col("__s") / F.col("__e")).desc_nulls_last()],
        "random": [hash_order([*keys, session], seed)],
    }[method]
    w = Window.partitionBy(*keys).orderBy(*order, F.col(session))
    return s.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*keys, session)


def hash_order(columns: list[str], seed: str) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns], F.lit(seed)))


def resolve_repeats(
    df: DataFrame, keys: list[str], session: str, night: str, effort: str, success: str, *, crop: str | None = None, combine: bool = True, same_crop: bool = False, method: str = "highest_effort", seed: str = "1"
) -> DataFrame:
    """One chain of nights for each key (a site's season).

    Rows without a session are empty surveys; one is kept (the smallest) of a key that has nothing else. A key with
    several sessions is combined, its nights running on, if ``combine`` and, with ``same_crop``, if all its rows have the same
    crop (null is a crop of its own); otherwise the best session by ``method`` is kept. Sessions of the same start are one.
    """
    full = df.where(F.col(session).isNotNull())
    crops = F.count_distinct(crop) + F.max(F.col(crop).isNull().cast("int")) if crop else F.lit(1)
    kinds = full.groupBy(*keys).agg(F.count_distinct(session).alias("__n"), crops.alias("__c"))
    chain = (F.col("__n") == 1) | (F.lit(combine) & ((F.col("__c") == 1) if same_crop else F.lit(True)))
    kinds = kinds.select(*keys, chain.alias("__chain"))
    full = join_ns(full, kinds, keys, "left")
    chained = chain_nights(full.where("__chain"), keys, session, night)
    rest = full.where("NOT __chain")
    picked = join_ns(rest, best_session(rest, keys, session, effort, success, method, seed), [*keys, session], "left_semi")
    empty = join_ns(df.where(F.col(session).isNull()).dropDuplicates(keys), kinds.select(*keys), keys, "left_anti")
    return chained.drop("__chain").unionByName(picked.drop("__chain").withColumn(night, F.col(night).cast("int"))).unionByName(empty.withColumn(night, F.col(night).cast("int")))


def duplicate_sessions(df: DataFrame, keys: list[str], period: str, detail: list[str]) -> DataFrame:
    """Distinct sessions of sites that have more than one in a period, with how many."""
    s = df.select(*keys, period, *detail).distinct()
    g = s.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("n_sessions")).where("n_sessions > 1")
    return join_ns(s, g, [*keys, period])


def first_and_rest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``capture_no`` within the keys and ``is_first``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("capture_no", F.row_number().over(w)).withColumn("is_first", F.col("capture_no") == 1)


def hold_out(df: DataFrame, area: list[str], site: str, observed: str, least: int, barred: Column, seed: str = "1") -> DataFrame:
    """(area, site): one random site of each area that has at least so many observed seasons and no barred row; the same for the same seed."""
    g = df.groupBy(*area, site).agg(F.count_distinct(observed).alias("__n"), F.coalesce(F.bool_or(barred), F.lit(False)).alias("__b"))
    g = g.where((F.col("__n") >= least) & ~F.col("__b"))
    w = Window.partitionBy(*area).orderBy(hash_order([*area, site], seed), F.col(site))
    return g.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*area, site)


MEASURES = {"traps": (("number_functional_traps1", "number_functional_traps2", "number_functional_traps3"), ("number_mice_caught1", "number_mice_caught2", "number_mice_caught3")), "chewcards": (("chewcards_deployed",), ("chewcards_chewed",)), "burrows": (("burrow_transects_searched",), ("burrow_transects_present",))}


def one_survey_a_month(df: DataFrame, survey_type: str, month: str, tie: str, *, method: str = "highest", keys: tuple[str, ...] = ("region", "site", "subsite", "longitude", "latitude"), measures: dict = MEASURES, seed: str = "1") -> DataFrame:
    """One row for each place and month: the one with the most effort, then the most success, then the smallest ``tie``; or, with ``random``, any one, the same for the same seed.

    Effort and success are the sums of the type's columns, nulls counting as nothing. Of the ``keys`` those count that the table has.
    """
    if method not in ("highest", "random"):
        raise ValueError(f"unknown method {method}")
    if survey_type not in measures:
        raise ValueError(f"unknown survey type {survey_type}")
    effort, success = measures[survey_type]
    lacking = [c for c in (*effort, *success) if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    by = [k for k in keys if k in df.columns] + [month]
    total = lambda cols: sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    order = [hash_order([*by, tie], seed), F.col(tie)] if method == "random" else [total(effort).desc(), total(success).desc(), F.col(tie)]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")
