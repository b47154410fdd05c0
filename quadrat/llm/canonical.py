"""Mapping freely typed values to a reference list by a partition-based pigeonhole join, in SQL.

A reference string cut into k + 1 segments keeps at least one segment unharmed by k edits, and that
segment then stands in the typed value near to where it was: with i segments before it and k - i behind it, some unharmed one
is no more than i places off counted from the start, and no more than k - i counted from the end. So typed values and
references meet in an equality join on (field, length, segment number, substring), and only what meets
is verified with levenshtein. Typed values are reduced to distinct spellings first, so the join runs over
the vocabulary and not over the rows; the rows are mapped by an equality join afterwards.

Words that no spelling can tell are learned from the rows, not listed: other words for an entry from the entries
that stand in the same context (the other nights of a visit), and words that add nothing from their standing
beside many entries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quadrat.sources.tables import cut

MAX_EDITS = 4
FILLER_WORDS = 3  # words that are dropped on either side of a value, at most
FILLER_ENTRIES = 3  # entries that a phrase has to stand beside before it counts as adding nothing
LEAST_CONTEXTS, LEAST_SHARE, LEAST_RATE = 2, 0.8, 0.25  # what a term is learned from, see learn_terms

NAME_EDITS = "CASE WHEN length(tight) <= 3 THEN 0 WHEN length(tight) <= 5 THEN 1 WHEN length(tight) <= 8 THEN 2 ELSE 3 END"


def max_edits_sql(length: str) -> str:
    """Edits allowed for a reference of that many letters: none for up to three, else one for each three, four at most."""
    return f"CASE WHEN {length} <= 3 THEN 0 WHEN {length} <= 5 THEN 1 WHEN {length} <= 7 THEN 2 WHEN {length} <= 10 THEN 3 ELSE {MAX_EDITS} END"


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """``text`` with :name: standing for a frame; the views have names of their own and are gone when it is analysed."""
    views = {k: f"q_{uuid.uuid4().hex}" for k in frames}
    for k, df in frames.items():
        df.createTempView(views[k])
        text = text.replace(f":{k}:", views[k])
    try:
        return spark.sql(text)
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def _words(expr: str) -> str:
    return rf"trim(regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}]+', ' '))"


def _spans_sql(view: str) -> str:
    """Each distinct value with every way to drop up to FILLER_WORDS words on either side: (field, value, pre, core, post)."""
    piece = lambda a, n: f"array_join(slice(ws, {a}, {n}), ' ')"
    return rf"""
      SELECT field, value, a + b AS dropped, {piece("1", "a")} AS pre, {piece("1 + a", "size(ws) - a - b")} AS core, {piece("1 + size(ws) - b", "b")} AS post
      FROM (SELECT field, value, split({_words("value")}, ' ') AS ws FROM (SELECT DISTINCT field, value FROM {view}))
      LATERAL VIEW explode(sequence(0, least(size(ws) - 1, {FILLER_WORDS}))) x AS a LATERAL VIEW explode(sequence(0, least(size(ws) - 1 - a, {FILLER_WORDS}))) y AS b"""


def reference_terms(spark: SparkSession, reference: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(field, ref_id, term, tight): each canonical value and each other term of an entry, in small letters; of equal terms that of the smaller ref_id."""
    more = "" if terms is None else f" UNION ALL SELECT field, ref_id, {_words('term')} FROM :terms:"
    frames = {"reference": reference} | ({} if terms is None else {"terms": terms})
    return run_sql(spark, f"""SELECT field, min(ref_id) AS ref_id, term, replace(term, ' ', '') AS tight FROM (SELECT field, ref_id, {_words("canonical")} AS term FROM :reference:{more}) WHERE term <> '' GROUP BY field, term""", **frames)


def learn_fillers(spark: SparkSession, values: DataFrame, reference: DataFrame) -> DataFrame:
    """(field, filler): phrases of up to FILLER_WORDS words that stand beside the exact names of FILLER_ENTRIES entries or more and are none themselves."""
    return run_sql(spark, f"""
      WITH spans AS ({_spans_sql(":values:")}),
      beside AS (SELECT s.field, concat(pre, post) AS filler, t.ref_id FROM spans s JOIN :terms: t ON s.field = t.field AND s.core = t.term WHERE dropped > 0 AND (pre = '' OR post = ''))
      SELECT b.field, b.filler FROM beside b LEFT ANTI JOIN :terms: t ON b.field = t.field AND b.filler = t.term GROUP BY b.field, b.filler HAVING count(DISTINCT ref_id) >= {FILLER_ENTRIES}""", values=values, terms=reference_terms(spark, reference))  # fmt: skip


def spellings(spark: SparkSession, values: DataFrame, fillers: DataFrame | None = None) -> DataFrame:
    """(field, value, tight, dropped): the forms in which each distinct value is looked up, without spaces: as it is, and without fillers at its ends, glued ones too."""
    if fillers is None:
        return run_sql(spark, f"SELECT field, value, replace(coalesce({_words('value')}, ''), ' ', '') AS tight, 0 AS dropped FROM (SELECT DISTINCT field, value FROM :values:)", values=values)
    return run_sql(spark, f"""
      WITH spans AS ({_spans_sql(":values:")}),
      whole AS (SELECT DISTINCT field, value, replace(core, ' ', '') AS tight FROM spans WHERE dropped = 0),
      glued AS (SELECT field, value, tight, explode(sequence(1, least(length(tight) - 1, 24))) AS n FROM whole WHERE length(tight) > 1),
      fit AS (
        SELECT s.field, s.value, replace(s.core, ' ', '') AS tight, s.dropped FROM spans s LEFT JOIN :fillers: p ON s.field = p.field AND s.pre = p.filler LEFT JOIN :fillers: q ON s.field = q.field AND s.post = q.filler
        WHERE (s.pre = '' OR p.filler IS NOT NULL) AND (s.post = '' OR q.filler IS NOT NULL)
        UNION ALL SELECT g.field, g.value, left(g.tight, length(g.tight) - g.n), 1 FROM glued g JOIN :fillers: f ON g.field = f.field AND right(g.tight, g.n) = replace(f.filler, ' ', ''))
      SELECT field, value, tight, min(dropped) AS dropped FROM fit GROUP BY field, value, tight
      UNION ALL SELECT DISTINCT field, value, '', 0 FROM :values: WHERE value IS NULL""", values=values, fillers=fillers)  # fmt: skip


def learn_terms(spark: SparkSession, rows: DataFrame, reference: DataFrame, mapped: DataFrame, forms: DataFrame) -> DataFrame:
    """(field, term, ref_id): forms of unmatched values that stand for an entry because it is what their contexts hold.

    ``rows`` has (field, value, context): what was entered, and what it was entered about (rows of one context mean
    the same thing). A form is learned if LEAST_CONTEXTS contexts or more have it beside one entry, if these are LEAST_SHARE or more of all
    (context, entry) pairs of the form, and if it stands beside that entry LEAST_RATE times as often as known spellings of an entry
    stand beside its canonical value, so that a rare slip in the contexts of a value that means nothing listed
    teaches nothing. Contexts count once, however many rows they have; of one no more is kept than its entries and forms.
    """
    lookup = run_sql(spark, """
      SELECT field, value, ref_id, true AS free, cast(null AS string) AS form FROM :mapped: WHERE ref_id <> 0 AND distance = 0
      UNION ALL SELECT field, canonical, ref_id, false, null FROM :reference:
      UNION ALL SELECT f.field, f.value, null, null, max_by(f.tight, struct(f.dropped, f.tight)) FROM :forms: f JOIN :mapped: m ON f.field = m.field AND f.value = m.value WHERE m.ref_id = 0 AND f.tight <> '' GROUP BY f.field, f.value""", mapped=mapped, reference=reference, forms=forms)  # fmt: skip
    return run_sql(spark, f"""
      WITH said AS (
        SELECT r.field, r.context, l.ref_id, l.form, max(NOT l.free) AS canonical, max(l.free) AS free
        FROM :rows: r JOIN :lookup: l ON r.field = l.field AND r.value = l.value GROUP BY r.field, r.context, l.ref_id, l.form),
      entries AS (SELECT field, context, ref_id, canonical, free FROM said WHERE ref_id IS NOT NULL),
      open AS (SELECT field, context, form FROM said WHERE form IS NOT NULL),
      usual AS (SELECT field, count_if(canonical AND free) / count_if(free) AS rate FROM entries GROUP BY field),
      seen AS (SELECT field, form, count(*) AS n FROM open GROUP BY field, form),
      pairs AS (SELECT o.field, o.form, e.ref_id, count(*) AS n FROM open o JOIN entries e ON o.field = e.field AND o.context = e.context GROUP BY o.field, o.form, e.ref_id),
      best AS (SELECT field, form, max_by(ref_id, struct(n, -ref_id)) AS ref_id, max(n) AS n, sum(n) AS n_all FROM pairs GROUP BY field, form)
      SELECT b.field, b.form AS term, b.ref_id FROM best b JOIN seen s ON b.field = s.field AND b.form = s.form JOIN usual u ON b.field = u.field
      WHERE b.n >= {LEAST_CONTEXTS} AND b.n >= {LEAST_SHARE} * b.n_all AND b.n >= {LEAST_RATE} * u.rate * s.n""", rows=rows, lookup=cut(lookup))  # fmt: skip


def map_values(spark: SparkSession, values: DataFrame, reference: DataFrame, *, terms: DataFrame | None = None, fillers: DataFrame | None = None, edits: str = max_edits_sql("length(tight)")) -> DataFrame:
    """(field, value, ref_id, distance) for each distinct (field, value); ref_id 0 and null distance if unmatched.

    ``values`` has (field, value), ``reference`` (field, ref_id, canonical), ``terms`` other words for entries (field, term,
    ref_id) and ``fillers`` phrases that add nothing (field, filler). Rules, the first that holds:
    the words are those of a term; they are once fillers, spaces and a plural s are dropped; the
    nearest term within max_edits, or within one edit more if the letters are the same (swapped
    letters count as two edits each). Equal distances go to the form with fewer words dropped, the longer term, then to the smaller ref_id.
    Null values and values without letters are unmatched. An empty reference list leaves all unmatched.
    """
    return _map(spark, spellings(spark, values, fillers), reference_terms(spark, reference, terms), edits)


def _map(spark: SparkSession, forms: DataFrame, terms: DataFrame, edits: str) -> DataFrame:
    return run_sql(spark, f"""
      WITH exact AS (
        SELECT s.field, s.value, min(named_struct('dropped', s.dropped, 'ref_id', t.ref_id)) AS m
        FROM (SELECT field, value, dropped, explode(array_distinct(array(tight, regexp_replace(tight, 's$', '')))) AS form FROM :forms:) s
        JOIN :terms: t ON s.field = t.field AND s.form = t.tight
        GROUP BY s.field, s.value),
      rest AS (SELECT s.field, s.value, s.tight, s.dropped FROM :forms: s LEFT ANTI JOIN exact e ON s.field = e.field AND s.value <=> e.value WHERE s.tight <> ''),
      sized AS (SELECT field, ref_id, tight, length(tight) AS n, 1 + {edits} AS k FROM :terms:),
      cuts AS (
        SELECT field, ref_id, tight, n, k, seg, floor(seg * n / (k + 1)) AS at, floor((seg + 1) * n / (k + 1)) - floor(seg * n / (k + 1)) AS len
        FROM (SELECT *, explode(sequence(0, k)) AS seg FROM sized WHERE k > 1)),
      segments AS (SELECT DISTINCT field, ref_id, tight, n, k, seg, cast(at AS int) AS at, cast(len AS int) AS len, substring(tight, cast(at AS int) + 1, cast(len AS int)) AS piece FROM cuts),
      shapes AS (SELECT DISTINCT field, n, at, len, k, seg FROM segments),
      windows AS (
        SELECT r.field, r.value, r.tight, r.dropped, h.n, h.at, h.len, h.k,
          greatest(0, h.at - h.seg, h.at + length(r.tight) - h.n - (h.k - h.seg)) AS lo, least(h.at + h.seg, h.at + length(r.tight) - h.n + (h.k - h.seg), length(r.tight) - h.len) AS hi
        FROM rest r JOIN shapes h ON r.field = h.field AND abs(length(r.tight) - h.n) <= h.k),
      probes AS (
        SELECT DISTINCT field, value, tight, dropped, n, at, len, k, substring(tight, p + 1, len) AS piece
        FROM (SELECT * FROM windows WHERE lo <= hi) LATERAL VIEW explode(sequence(lo, hi)) x AS p),
      near AS (
        SELECT p.field, p.value, min(named_struct('d', levenshtein(p.tight, s.tight), 'dropped', p.dropped, 'n', -length(s.tight), 'ref_id', s.ref_id)) AS m
        FROM probes p JOIN segments s ON p.field = s.field AND p.n = s.n AND p.at = s.at AND p.len = s.len AND p.k = s.k AND p.piece = s.piece
        WHERE levenshtein(p.tight, s.tight) <= s.k - CASE WHEN array_sort(split(p.tight, '')) = array_sort(split(s.tight, '')) THEN 0 ELSE 1 END
        GROUP BY p.field, p.value)
      SELECT field, value, m.ref_id AS ref_id, 0 AS distance FROM exact
      UNION ALL SELECT field, value, m.ref_id, m.d FROM near
      UNION ALL SELECT r.field, r.value, 0, cast(null AS int) FROM (SELECT DISTINCT field, value FROM :forms:) r
        LEFT ANTI JOIN exact e ON r.field = e.field AND r.value <=> e.value
        LEFT ANTI JOIN near n ON r.field = n.field AND r.value <=> n.value""", forms=forms, terms=terms)  # fmt: skip


def map_entries(spark: SparkSession, rows: DataFrame, reference: DataFrame, *, terms: DataFrame | None = None) -> DataFrame:
    """(field, value, ref_id, distance, rule) of each distinct (field, value) of ``rows`` that is no canonical value; rule: spelling, context or unmatched.

    ``rows`` has (field, value, context), see learn_terms; a null context teaches nothing. Fillers are learned first, then values are mapped
    by their spelling, then terms are learned from the contexts of what is still unmatched, and the rest is mapped
    to them, in exact form or with edits. ``terms`` (field, term, ref_id) are other words that are known beforehand; none are needed.
    """
    counted = cut(rows.where("value IS NOT NULL").groupBy("field", "value").count())  # the rows are read once for their vocabulary
    values = run_sql(spark, "SELECT v.field, v.value FROM :v: v LEFT ANTI JOIN :reference: r ON v.field = r.field AND v.value = r.canonical", v=counted, reference=reference)
    forms = cut(spellings(spark, values, learn_fillers(spark, values, reference)))
    edits = max_edits_sql("length(tight)")
    first = cut(_map(spark, forms, reference_terms(spark, reference, terms), edits))
    learned = cut(learn_terms(spark, rows.where("context IS NOT NULL"), reference, first, forms))
    left = run_sql(spark, "SELECT f.* FROM :forms: f LEFT SEMI JOIN :m: m ON f.field = m.field AND f.value = m.value AND m.ref_id = 0", forms=forms, m=first)
    again = _map(spark, left, run_sql(spark, "SELECT field, min(ref_id) AS ref_id, term, term AS tight FROM :t: GROUP BY field, term", t=learned), edits)
    return cut(run_sql(spark, "SELECT *, 'spelling' AS rule FROM :a: WHERE ref_id <> 0 UNION ALL SELECT *, CASE WHEN ref_id = 0 THEN 'unmatched' ELSE 'context' END FROM :b:", a=first, b=again))
