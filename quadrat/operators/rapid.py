"""Rapid assessments: burrow transects and chew cards, their measures, checks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators.quality import Rule

SEGMENTS = 4  # segments of 25 m in a transect of 100 m
# Fixed value: the start of a comment that marks counts which lump several transects together.
LUMPED = "Values 0-25 are the total number of active burrows lumped"


def transect_totals(df: DataFrame, segments: list[str], *, per: int = SEGMENTS, prefix: str = "active_burrows_t") -> DataFrame:
    """``df`` with ``{prefix}1``...: the sum of each ``per`` segments in order, null if one of them is null; the segments are dropped.

    The number of segments has to be a multiple of ``per``.
    """
    if len(segments) % per:
        raise ValueError(f"{len(segments)} segments do not make transects of {per}")
    groups = [segments[i : i + per] for i in range(0, len(segments), per)]
    return df.withColumns({f"{prefix}{n}": sum((F.col(c) for c in g[1:]), F.col(g[0])) for n, g in enumerate(groups, 1)}).drop(*segments)


def numbered_columns(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Columns renamed to ``{prefix}1``... in the order given: names bound by position."""
    return df.withColumnsRenamed({c: f"{prefix}{n}" for n, c in enumerate(columns, 1)})


def _count(columns: list[str], holds: object) -> Column:
    return sum((F.coalesce(holds(F.col(c)).cast("int"), F.lit(0)) for c in columns), F.lit(0))


def burrow_measures(df: DataFrame, transects: list[str]) -> DataFrame:
    """``df`` with transects searched and present, metres searched, the count of burrows and whether there are any; null where no transect was searched."""
    n = _count(transects, lambda c: c.isNotNull())
    some = lambda c: F.when(n > 0, c)
    total = some(sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in transects), F.lit(0.0)))
    return df.withColumns({
        "burrow_transects_searched": some(n), "burrow_transects_present": some(_count(transects, lambda c: c > 0)), "burrow_total_metres": some(n * 100),
        "burrow_total_count": total, "burrow_site_present": (total > 0).cast("int"),
    })


def card_measures(df: DataFrame, cards: list[str]) -> DataFrame:
    """``df`` with cards deployed (with a value) and chewed (above 0), and whether any was chewed."""
    chewed = _count(cards, lambda c: c > 0)
    return df.withColumns({"chewcards_deployed": _count(cards, lambda c: c.isNotNull()), "chewcards_chewed": chewed, "chewcard_site_present": (chewed > 0).cast("int")})


def split_methods(df: DataFrame, comments: str = "comments") -> tuple[DataFrame, DataFrame]:
    """(burrows, cards): the distinct rows of each method where it was used; burrow rows whose comment says that counts are lumped are left out."""
    burrows = df.select(*[c for c in df.columns if not c.startswith("chewcard")]).distinct()
    burrows = burrows.where((F.col("burrow_transects_searched") >= 1) & ~F.coalesce(F.contains(comments, F.lit(LUMPED)), F.lit(False)))
    cards = df.select(*[c for c in df.columns if not c.startswith(("active_burrows_t", "burrow_"))]).where("chewcards_deployed >= 1").distinct()
    return burrows, cards


def survey_rules(start: str, end: str, *, longest: int = 6) -> list[Rule]:
    """Rules on a survey's dates: end before start, longer than ``longest`` days, cards collected on the day they were set."""
    days = F.datediff(end, start)
    return [
        Rule("end_before_start", "error", days < 0, F.col(end)),
        Rule("long_survey", "error", days > longest, days),
        Rule("same_day", "error", days == 0, F.col(start)),
    ]


def percent_rules(columns: list[str]) -> list[Rule]:
    return [Rule(f"percent_{c}", "error", ~F.col(c).between(0, 100), F.col(c)) for c in columns]


def measure_summary(df: DataFrame, columns: list[str], kind: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, kind, n_values, least, most, mean, median, pct_positive) of the non-null values of several columns taken together."""
    keys = keys or []
    one = df.select(*keys, F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    g = one.groupBy(*keys) if keys else one
    return g.agg(
        F.lit(kind).alias("kind"), F.count("v").alias("n_values"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"), F.median("v").alias("median"),
        (100.0 * F.count_if(F.col("v") > 0) / F.nullif(F.count("v"), F.lit(0))).alias("pct_positive"),
    )
