"""Delimited files whose headers, order, delimiters and types drift: one typed table and a change report.

Rows are loaded as maps from path (the plain header) to value, raw types are counted by file and path, and headers
that no alias names are told from the files themselves: where one comes as a field goes, file after file, and never stands
beside it, it is that field under another name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.sources.tables import cut

# The headers under which a field is known, without case, spaces, dots and underscores.
HEADER_ALIASES = {
    "crop_type": ("croptype", "cropname", "croptypeold", "cropgrown", "crop"),
    "crop_stage": ("cropstage", "cropstageold", "growthstage", "stage"),
    "subsite": ("subsite", "paddock", "datasitename", "datasitenameold"),
    "site": ("site", "sitename", "property", "farm"),
    "region": ("region", "areaname", "area"),
    "capture_date": ("capturedate", "trapdate", "date"),
    "survey_night": ("surveynight", "night"),
    "trap_type": ("traptype", "trapmodel"),
    "traps_set": ("trapsset", "ntraps", "numbertrapsset"),
    "phantoms": ("phantoms", "numberphantoms", "falsetriggers"),
    "mice_caught": ("micecaught", "mice", "numbermicecaught", "totalcaptures"),
    "weight_g": ("weightg", "weight"),
    "length_mm": ("lengthmm", "length"),
    "longitude": ("longitude", "xcoord", "eastingdeg"),
    "latitude": ("latitude", "ycoord", "northingdeg"),
    "ground_cover_percent": ("groundcoverpercent", "groundcoverpc", "groundcover"),
    "biomass": ("biomass", "biomassnew"),
    "pit_tag": ("pittag", "tagread"),
    "observer_comment": ("observercomment", "comments", "remarks"),
}
DELIMITERS = (",", ";", "\t", "|")
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def _escaped(delimiter: str) -> str:
    return {"|": r"\|", "\t": r"\t"}.get(delimiter, delimiter)


def delimiter_of(header: Column) -> Column:
    """The commonest of the known delimiters in a header line; ties go to the earlier one of DELIMITERS."""
    counts = F.array(*[F.struct((F.length(header) - F.length(F.replace(header, F.lit(d)))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    return F.array_max(counts)["d"]


def split_fields(line: Column, delimiter: Column) -> Column:
    """Fields of a delimited line; a value in double quotes may hold the delimiter, doubled quotes mean one.

    One pass of a possessive pattern, so the time is linear in the length of the line.
    """
    out = None
    for d in DELIMITERS:
        e = _escaped(d)
        parts = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(f'{e}(?:\\s*"[^"]*+(?:""[^"]*+)*+"[^{e}]*+|[^{e}]*+)'), F.lit(0))
        out = F.when(delimiter == d, parts) if out is None else out.when(delimiter == d, parts)

    def clean(x: Column) -> Column:
        v = F.trim(F.substring(x, 2, 2147483647))
        inner = F.substring(v, F.lit(2), F.length(v) - 2)
        return F.when(v.rlike(r'^".*"$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(v)

    return F.transform(out, clean)


def plain_header(header: Column) -> Column:
    """Header without case, spaces, dots and underscores: what counts when headers are compared."""
    return F.regexp_replace(F.lower(header), r"[\s._﻿]+", "")


KINDS = ("integer", "decimal", "date", "text")


def value_kind(v: Column) -> Column:
    """Raw type of one value: null if blank, else integer, decimal, date or text. Only values with digits are matched against patterns."""
    s = F.lower(F.trim(v))
    signs = F.translate(s, "0123456789", "")
    digits = F.length(s) > F.length(signs)
    day, month = r"(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|1[0-2])"
    date = rf"^(\d{{4}}[-/.]{month}[-/.]{day}|{day}[-/. ]{month}[-/. ]\d{{2,4}}|{month}/{day}/\d{{2,4}}|{day}[- ]({MONTHS})[a-z]*[-, ]+\d{{2,4}}|({MONTHS})[a-z]* {day},? \d{{2,4}})([ t]\d{{1,2}}:\d{{2}}.*)?$"
    return (
        F.when(s.isNull() | (s == ""), None)
        .when(~digits, "text")
        .when((signs == "") | (signs.isin("+", "-") & s.startswith(signs)), "integer")
        .when((F.length(signs) <= 4) & s.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)(e[+-]?\d+)?$"), "decimal")
        .when(s.rlike(date), "date")
        .otherwise("text")
    )


def alias_table(files: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """(path, field) of the stated aliases."""
    return files.sparkSession.createDataFrame([(name, field) for field, names in aliases.items() for name in names], "path string, field string")


def headers(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, delimiter, paths): the plain headers of each file that has a header line (line 0; of several the smallest). A header that stands twice has its place added."""
    h = lines.where(F.col("line_no") == 0).groupBy("file_id").agg(F.min("line").alias("_h")).join(files.select("file_id").distinct(), "file_id", "left_semi")
    h = h.withColumn("delimiter", delimiter_of(F.col("_h"))).withColumn("_p", F.transform(split_fields(F.col("_h"), F.col("delimiter")), plain_header))
    once = F.transform("_p", lambda p, i: F.when(F.array_position("_p", p) == i + 1, p).otherwise(F.concat_ws("#", p, (i + 1).cast("string"))))
    return h.select("file_id", "delimiter", once.alias("paths"))


def _split_lines(lines: DataFrame, header: DataFrame) -> DataFrame:
    """(file_id, line_no, paths, vals) of the data lines; missing trailing values are null, surplus ones dropped."""
    rows = lines.select("file_id", "line_no", "line").where(F.col("line_no") > 0).join(header, "file_id")
    vals = split_fields(F.col("line"), F.col("delimiter"))
    return rows.select("file_id", "line_no", "paths", F.slice(vals, F.lit(1), F.size("paths")).alias("vals"))


def path_values(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, line_no, values MAP<path, value>) of each data line.

    Lines of a file are joined to its header (line 0). Lines of files without a header, and files
    without lines, give no row. Missing trailing values are null, surplus ones are dropped.
    """
    rows = _split_lines(lines, headers(files, lines))
    return rows.select("file_id", "line_no", F.map_from_entries(F.transform("paths", lambda p, i: F.struct(p, F.get("vals", i)))).alias("values"))


def path_types(lines: DataFrame, header: DataFrame) -> DataFrame:
    """(file_id, path, place, n_values, n_blank, n_integer, n_decimal, n_date, n_text, kind): counts of each raw type of a path in a file.

    Kinds: integer if all non-blank values are whole numbers, decimal if all are numbers, date if all are
    calendar dates, else text; null if all are blank or the file has no data lines. Counts are summed before the shuffle.
    """
    rows = _split_lines(lines, header)
    flat = rows.select("file_id", F.posexplode(F.transform("vals", value_kind)).alias("place", "kind"))
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    counts = flat.groupBy("file_id", "place").agg(F.count("kind").alias("n_values"), F.count_if(F.col("kind").isNull()).alias("n_blank"), *[count(k) for k in KINDS])
    n = F.col("n_values")
    kind = F.when(n == 0, None).when(F.col("n_integer") == n, "integer").when(F.col("n_integer") + F.col("n_decimal") == n, "decimal").when(F.col("n_date") == n, "date").otherwise("text")
    return header.select("file_id", F.posexplode("paths").alias("place", "path")).join(counts.withColumn("kind", F.when(n.isNotNull(), kind)), ["file_id", "place"], "left")


def learn_aliases(files: DataFrame, types: DataFrame, known: DataFrame) -> DataFrame:
    """(path, field) of headers that are none of ``known`` (path, field), as far as the files tell which field they are.

    ``types`` is what path_types gives. In every pair of files that follow each other in a feed, a header that only one of
    them has may be any field that only the other has; it counts twice if both have the same type. A header is the field with the highest
    count, if that is twice the next one's and if the two stand together in no more than one file of fifty. What is
    learned is known for the next turn, until nothing new is found. Headers without evidence stay unknown.
    """
    order = Window.partitionBy("feed_id").orderBy("file_no", "file_id")
    seq = files.select("file_id", "feed_id", "file_no").dropDuplicates(["file_id"]).join(types.select("file_id").distinct(), "file_id", "left_semi")
    seq = seq.withColumn("b", F.lag("file_id").over(order)).where("b IS NOT NULL").select(F.col("file_id").alias("a"), "b")
    pairs = cut(seq.unionByName(seq.select(F.col("b").alias("a"), F.col("a").alias("b"))))  # both ways
    stored = cut(types.select("file_id", "path", "kind"))
    learned = None
    while True:
        now = known if learned is None else known.unionByName(learned)
        fields = stored.join(now, "path").groupBy("file_id", "field").agg(F.min("kind").alias("kind"))
        free = stored.join(now, "path", "left_anti")
        beside = free.join(fields.select("file_id", "field"), "file_id").groupBy("path", "field").agg(F.count(F.lit(1)).alias("n_beside"))
        come = pairs.join(free.withColumnRenamed("file_id", "a"), "a").join(stored.select(F.col("file_id").alias("b"), "path"), ["b", "path"], "left_anti")
        gone = pairs.join(fields.select(F.col("file_id").alias("b"), "field", F.col("kind").alias("kind_b")), "b").join(fields.select(F.col("file_id").alias("a"), "field"), ["a", "field"], "left_anti")
        swaps = come.join(gone, ["a", "b"]).groupBy("path", "field").agg(F.sum(F.when(F.col("kind") == F.col("kind_b"), 2).otherwise(1)).alias("n"))
        files_of = free.groupBy("path").agg(F.count(F.lit(1)).alias("n_files"))
        fit = swaps.join(beside, ["path", "field"], "left").join(files_of, "path").where(F.coalesce("n_beside", F.lit(0)) * 50 <= F.col("n_files"))
        best = fit.groupBy("path").agg(F.max_by("field", F.struct("n", "field")).alias("field"), F.max("n").alias("n"), F.sum("n").alias("total")).where(F.col("n") >= 2 * (F.col("total") - F.col("n")))
        new = cut(best.select("path", "field"))
        if new.isEmpty():
            return learned if learned is not None else new
        learned = new if learned is None else learned.unionByName(new)


def schema_changes(files: DataFrame, lines: DataFrame, aliases: dict[str, tuple[str, ...]] = HEADER_ALIASES) -> DataFrame:
    """Changes of each file against its feed's previous one by file_no: (file_id, change_kind, field_name, before, after).

    added, removed, renamed (the plain header differs) and retyped (the type of the non-blank values
    differs; a field with only blanks in either file has no type to compare). Fields are those that ``aliases`` name a header by, or
    that learn_aliases finds; other headers are compared under their own plain header. The first file of a feed has no changes; repeated lines and
    late files make none. If a field stands twice in a header, its smallest plain header counts.
    """
    header = cut(headers(files, lines))
    types = cut(path_types(lines, header).select("file_id", "path", "kind"))
    known = alias_table(files, aliases)
    known = known.unionByName(learn_aliases(files, types, known))
    cols = types.join(known, "path", "left").groupBy("file_id", F.coalesce("field", "path").alias("field_name")).agg(F.min_by(F.struct("path", "kind"), "path").alias("c"))
    per_file = cols.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "c"))).alias("m"))
    order = Window.partitionBy("feed_id").orderBy("file_no", "file_id")
    seq = files.select("file_id", "feed_id", "file_no").dropDuplicates(["file_id"]).join(per_file, "file_id")
    seq = seq.withColumn("p", F.lag("m").over(order)).where(F.col("p").isNotNull())
    names = F.array_union(F.map_keys("m"), F.map_keys("p"))
    d = seq.select("file_id", F.explode(names).alias("field_name"), "m", "p")
    d = d.select("file_id", "field_name", F.try_element_at("m", F.col("field_name")).alias("a"), F.try_element_at("p", F.col("field_name")).alias("b"))
    kind = lambda name, before, after: F.struct(F.lit(name).alias("change_kind"), before.alias("before"), after.alias("after"))
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()
    found = F.array_compact(
        F.array(
            F.when(b.isNull(), kind("added", F.lit(None).cast("string"), a["path"])),
            F.when(a.isNull(), kind("removed", b["path"], F.lit(None).cast("string"))),
            F.when(both & (a["path"] != b["path"]), kind("renamed", b["path"], a["path"])),
            F.when(both & (a["kind"] != b["kind"]), kind("retyped", b["kind"], a["kind"])),
        )
    )
    return d.select("file_id", "field_name", F.inline(found)).select("file_id", "change_kind", "field_name", "before", "after")


def parse_date(v: Column) -> Column:
    """Date of any of the known notations, spreadsheet day numbers included; day before month where both fit."""
    s = F.initcap(F.trim(v))
    tries = [F.try_to_timestamp(s, F.lit(f)).cast("date") for f in ("yyyy-M-d", "d/M/yyyy", "d MMM yyyy", "M/d/yyyy")]
    serial = F.when(s.rlike(r"^\d{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), s.cast("int")))
    return F.coalesce(serial, *[F.when(~s.rlike(r"^\d+$"), t) for t in tries])


def unified_table(files: DataFrame, lines: DataFrame, fields: dict[str, str], aliases: dict[str, tuple[str, ...]] = HEADER_ALIASES) -> DataFrame:
    """One row for each distinct data line, with a typed column for each canonical field and ``failed_casts``.

    ``fields`` maps field names to text, integer, decimal or date. Blank values are null. Units and
    words around a number are dropped ('2 sprung', '18.5 g', 'night 3', '40%'; a trailing S or W makes it
    negative); a value that still can't be cast is null and its field is listed in ``failed_casts``.
    Repeated lines of a file are kept once, with the smallest line_no. Headers that no alias names are learned as in schema_changes.
    """
    header = cut(headers(files, lines))
    known = alias_table(files, aliases)
    known = known.unionByName(learn_aliases(files, path_types(lines, header).select("file_id", "path", "kind"), known))
    paths = header.select("file_id", F.explode("paths").alias("path")).join(known, "path").groupBy("file_id", "field").agg(F.min("path").alias("path"))
    places = header.join(paths.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "path"))).alias("_m")), "file_id", "left")
    values = path_values(files, lines).join(places.select("file_id", "_m"), "file_id")
    raw = values.select("file_id", "line_no", *[F.nullif(F.trim(F.try_element_at("values", F.try_element_at("_m", F.lit(f)))), F.lit("")).alias(f) for f in fields])
    raw = raw.groupBy("file_id", *fields).agg(F.min("line_no").alias("line_no"))
    out, failed = [], []
    for f, kind in fields.items():
        c = F.col(f)
        num = F.regexp_extract(c, r"([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")
        num = F.when(c.rlike(r"(?i)\d\s*[sw]$"), -F.abs(num)).otherwise(num)
        v = {"integer": F.when(num == F.floor(num), num.try_cast("int")), "decimal": num, "date": parse_date(c)}.get(kind, c)
        out.append(v.alias(f))
        failed.append(F.when(c.isNotNull() & v.isNull(), F.lit(f)))
    return raw.select("file_id", "line_no", *out, F.array_compact(F.array(*failed)).alias("failed_casts"))
