"""Filling missing values from records of the same group or time.

Numbers: a mixed-effects prediction, mean + time + unit + visit effect. The variance components are moments of the
level means; with the visit effect integrated out by weights, time and unit effects are fitted jointly, in sweeps
until they settle, each shrunk towards zero, and the visit effect is what is left of a visit, shrunk too. Categories:
nested multinomial models, visit within unit within time within all, each level smoothed by the next wider one. Only
rows that lack a value are joined to the effects, once; what is shuffled of the rest is one pre-aggregated row for each
visit, so that a unit with a third of all rows weighs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.missing import plain_words
from quadrat.functions.nullsafe import join_ns
from quadrat.sources.tables import cut

SWEEPS, SETTLED = 25, 1e-3
RARE = 1 / 1000  # share of the values that an unlisted category needs, so there are no more than 1,000


def fill_numeric(
    df: DataFrame,
    value: str,
    missing: Column,
    *,
    visit: list[str],
    unit: list[str],
    time: list[str],
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """``df`` plus ``{value}_filled`` (the value or its prediction) and ``{value}_was_missing``.

    ``visit`` has to hold the columns of ``unit`` and ``time``; ``time`` has the steps of a calendar, and one number for
    each step comes to the driver in each sweep. A null group key contributes no effect: the prediction then rests on
    the other levels. If no row has a value, the filled value
    is null and the mask stays true. Predictions are clipped to [low, high]. Repeated rows count
    as often as they occur; extra columns are kept, those named like the two new ones replaced.
    """
    mark, out = f"{value}_was_missing", f"{value}_filled"
    df = df.drop(mark, out)
    d = df.withColumn(mark, missing)
    y = F.col(value).cast("double")
    seen = d.where(~F.col(mark)).groupBy(*visit).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"), F.sum(y * y).alias("_ss"))
    seen = cut(seen)  # one row for each visit; the levels are fitted on it
    model = _components(seen, visit, unit, time)
    if model is None:
        return d.withColumn(out, F.when(~F.col(mark), y))
    mu, within, k_visit, k_unit, k_time = model
    known = lambda keys: F.lit(True) if not keys else sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) == 0
    # weight of a visit's mean with the visit effect integrated out, in units of the variance of one value
    w = F.col("_n") * k_visit / (F.col("_n") + k_visit)
    rest = seen.select(*visit, "_n", w.alias("_w"), (F.col("_s") / F.col("_n") - mu).alias("_m"))
    step = F.when(known(time), F.xxhash64(*time))
    cells = rest.groupBy(*unit, step.alias("_t")).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_m")).alias("r"))
    # one row for each unit: its weight and sum at each step, as many as the calendar has
    units = cut(cells.groupBy(*unit).agg(F.collect_list(F.struct(F.col("_t").alias("t"), "w", "r")).alias("_c")))
    times: dict[int, float] = {}

    def at(t: Column) -> Column:
        return F.coalesce(F.try_element_at(steps, t), F.lit(0.0)) if times else F.lit(0.0)

    for _ in range(SWEEPS):
        steps = F.lit(None) if not times else F.map_from_arrays(F.lit([*times]), F.lit([*times.values()]))
        level = _unit_effect(known(unit), at, k_unit)
        left = units.select(F.inline(F.transform("_c", lambda c: F.struct(c["t"].alias("t"), c["w"].alias("w"), (c["r"] - c["w"] * level).alias("r")))))
        new = {r.t: r.e for r in left.where("t IS NOT NULL").groupBy("t").agg((F.sum("r") / (F.sum("w") + k_time)).alias("e")).collect()}
        moved = max((abs(e - times.get(t, 0.0)) for t, e in new.items()), default=0.0)
        times = new
        if moved <= SETTLED * within**0.5:
            break
    steps = F.lit(None) if not times else F.map_from_arrays(F.lit([*times]), F.lit([*times.values()]))
    effects = units.select(*unit, _unit_effect(known(unit), at, k_unit).alias("__fill_u"))
    shrunk = seen.select(*visit, (F.col("_n") / (F.col("_n") + k_visit)).alias("__fill_k"), (F.col("_s") / F.col("_n") - mu).alias("__fill_m"))
    gaps = d.where(F.col(mark))
    wanted = join_ns(gaps.select(*visit).distinct(), effects, unit, "left")
    wanted = join_ns(wanted, shrunk.where(known(visit)), visit, "left")
    base = at(step) + F.coalesce("__fill_u", F.lit(0.0))
    guess = F.lit(mu) + base + F.coalesce(F.col("__fill_k") * (F.col("__fill_m") - base), F.lit(0.0))
    guess = guess if low is None else F.greatest(guess, F.lit(low))
    guess = guess if high is None else F.least(guess, F.lit(high))
    gaps = join_ns(gaps, wanted.select(*visit, guess.alias(out)), visit, "left").select(*d.columns, out)
    return d.where(~F.col(mark)).withColumn(out, y).unionByName(gaps)


def _unit_effect(known: Column, at: object, k: float) -> Column:
    """A unit's effect given those of the steps: its weighted mean residual, shrunk."""
    sums = F.aggregate("_c", F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("r")), lambda a, c: F.struct((a["w"] + c["w"]).alias("w"), (a["r"] + c["r"] - c["w"] * at(c["t"])).alias("r")), lambda a: a["r"] / (a["w"] + k))
    return F.when(known, sums).otherwise(0.0)


def _components(seen: DataFrame, visit: list[str], unit: list[str], time: list[str]) -> tuple[float, float, float, float, float] | None:
    """(mean, variance within visits, and the ratio of that to the variance of visits, units and times); None without values.

    One pass: the sums of all levels come from grouping sets, and each level's variance is that of its means less what the levels
    below it and the values themselves put there. A level with no variance of its own gets a ratio that shrinks it to nothing.
    """
    flat = seen.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(visit)], "_n", "_s", F.col("_ss"))
    name = {c: f"k{i}" for i, c in enumerate(visit)}
    levels = {"visit": visit, "unit": unit, "time": time}
    sets = [[F.col(name[c]) for c in keys] for keys in levels.values()]
    ids = {n: sum(1 << (len(visit) - 1 - i) for i, c in enumerate(visit) if c not in keys) for n, keys in levels.items()}
    sums = flat.groupingSets([*sets, []], *[F.col(name[c]) for c in visit]).agg(F.grouping_id().alias("_g"), F.sum("_n").alias("n"), F.sum("_s").alias("s"), F.sum("_ss").alias("ss"), F.count(F.lit(1)).alias("v"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("q"))
    total = F.first(F.when(F.col("_g") == (1 << len(visit)) - 1, F.struct("n", "s", "ss", "v", "q")), True)
    mean = F.col("s") / F.col("n")
    per = {n: F.struct(F.var_pop(F.when(F.col("_g") == i, mean)).alias("a"), F.avg(F.when(F.col("_g") == i, 1 / F.col("n"))).alias("b"), F.avg(F.when(F.col("_g") == i, 1 / F.col("v"))).alias("c")) for n, i in ids.items()}
    row = sums.agg(total.alias("all"), *[c.alias(n) for n, c in per.items()]).head()
    if row is None or row["all"] is None or not row["all"]["n"]:
        return None
    t = row["all"]
    within = max(1e-6, (t["ss"] - t["q"]) / max(1, t["n"] - t["v"]))
    floor = 1e-3 * within
    spread = {n: (row[n]["a"] or 0.0) - within * (row[n]["b"] or 0.0) for n in levels}
    both = max(0.0, spread["visit"])  # of units, times and visits together
    var_t, var_u = (max(0.0, spread[n] - both * (row[n]["c"] or 0.0)) for n in ("time", "unit"))
    var_v = max(0.0, both - var_t - var_u)
    return t["s"] / t["n"], within, *(within / max(floor, v) for v in (var_v, var_u, var_t))


def fill_category(
    df: DataFrame,
    value: str,
    missing: Column,
    categories: DataFrame,
    *,
    visit: list[str],
    unit: list[str],
    time: list[str],
    mapping: DataFrame | None = None,
    prior: float = 2.0,
) -> DataFrame:
    """``df`` plus ``{value}_filled`` and ``{value}_was_missing``; missing values get the likeliest category.

    ``categories`` is the one-column list of names that values may have. A value teaches the category that ``mapping``
    (value, category) gives it, else the only listed name among its words (case and punctuation don't matter); other values
    are categories of their own, in small letters, if RARE of all values or more have them. Each level's
    multinomial has ``prior`` pseudo-counts of the next wider level. Ties go to the larger name in
    string order; null group keys fall back on the wider levels; without any usable value the fill is null. Values
    that are there stay as they are.
    """
    mark, out = f"{value}_was_missing", f"{value}_filled"
    df = df.drop(mark, out)
    d = df.withColumn(mark, missing)
    raw = d.where(~F.col(mark)).groupBy(*visit, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    spellings = raw.groupBy("_v").agg(F.sum("_n").alias("_n"))
    names = categories.toDF("_c").select("_c", plain_words(F.col("_c")).alias("_p")).where("_p <> ''").agg(F.collect_set(F.struct("_p", "_c"))).scalar()
    text = F.concat(F.lit(" "), plain_words(F.col("_v")), F.lit(" "))
    inside = F.filter(F.coalesce(F.col("_l"), F.array().cast("array<struct<_p:string,_c:string>>")), lambda c: F.contains(text, F.concat(F.lit(" "), c["_p"], F.lit(" "))))
    listed = F.when(F.size(inside) == 1, F.get(inside, F.lit(0))["_c"])
    stated = spellings.withColumn("_to", F.lit(None).cast("string")) if mapping is None else spellings.join(mapping.toDF("_v", "_to").groupBy("_v").agg(F.min("_to").alias("_to")), "_v", "left")
    taught = cut(stated.withColumn("_l", names).select("_v", "_n", F.coalesce("_to", listed).alias("_c"), plain_words(F.col("_v")).alias("_own")))
    own = taught.where("_c IS NULL AND _own <> ''").groupBy("_own").agg(F.sum("_n").alias("_n"))
    own = own.where(F.col("_n") >= taught.agg(F.sum("_n") * RARE).scalar()).select("_own", F.lit(True).alias("_often"))
    lookup = taught.join(own, "_own", "left").select("_v", F.coalesce("_c", F.when(F.col("_often"), F.col("_own"))).alias("_c")).where("_c IS NOT NULL")
    seen = cut(join_ns(raw, lookup, ["_v"]).groupBy(*visit, "_c").agg(F.sum("_n").alias("_n")))

    def level(keys: list[str], name: str) -> DataFrame:
        counts = seen.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n"))
        return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_c", F.col("_n").cast("double")))).alias(name), F.sum("_n").cast("double").alias(f"{name}n"))

    every = {r[0]: float(r[1]) for r in seen.groupBy("_c").agg(F.sum("_n")).collect()}  # the listed categories and 1 / RARE more at most
    if not every:
        return d.withColumn(out, F.when(~F.col(mark), F.col(value)))
    whole = sum(every.values())
    gaps = d.where(F.col(mark))
    wanted = gaps.select(*visit).distinct()
    names_ = ("__fill_t", "__fill_u", "__fill_v")
    for name, keys in zip(names_, (time, unit, visit)):
        wanted = wanted.join(level(keys, name), keys, "left")

    def chance(c: Column) -> Column:
        p = c["n"] / whole
        for name in names_:
            p = (F.coalesce(F.try_element_at(F.col(name), c["c"]), F.lit(0.0)) + prior * p) / (F.coalesce(F.col(f"{name}n"), F.lit(0.0)) + prior)
        return F.struct(p.alias("p"), c["c"].alias("c"))

    overall = F.arrays_zip(F.lit([*every]).alias("c"), F.lit([*every.values()]).alias("n"))
    best = wanted.select(*visit, F.array_max(F.transform(overall, chance))["c"].alias(out))
    filled = join_ns(gaps, best, visit, "left").select(*d.columns, out)
    return d.where(~F.col(mark)).withColumn(out, F.col(value)).unionByName(filled)
