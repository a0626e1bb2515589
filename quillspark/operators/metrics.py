"""Journal metrics: prioritised key lookup, threshold, split and governance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# Fields that name a row's journal and its ISSNs, in order of preference.
NAME_FIELDS = ("crossref_container", "journal", "container", "source", "source_query_name")
ISSN_FIELDS = ("crossref_issn", "issn", "journal_issn")
#: The dimension is broadcast only up to so many keys and bytes of keys and metric rows; beyond it the join shuffles.
BROADCAST_KEYS, BROADCAST_BYTES = 200_000, 64 << 20


def keys(metrics: DataFrame) -> DataFrame:
    """(kind, key, metric row): ISSNs, then names and aliases; of equal keys the last row wins."""
    issn = F.transform(T.items("issn"), lambda x: F.struct(F.lit("issn").alias("kind"), T.issn(x).alias("key")))
    name = F.transform(F.concat(F.array("journal"), T.items("aliases")), lambda x: F.struct(F.lit("name").alias("kind"), T.journal(x).alias("key")))
    rows = metrics.where(T.strip("journal") != "").select("_ord", F.struct(*[c for c in metrics.columns if c != "_ord"]).alias("metric"), F.explode(F.concat(issn, name)).alias("k"))
    rows = rows.select(F.col("k.kind").alias("kind"), F.col("k.key").alias("key"), "_ord", "metric").where("key <> ''")
    return rows.groupBy("kind", "key").agg(F.max_by("metric", "_ord").alias("metric"))


def match(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """Adds ``metric``: the first hit by ISSN fields, then by name fields; exact keys only. Needs a unique _ord."""
    own = [c for c in ISSN_FIELDS if c in df.columns], [c for c in NAME_FIELDS if c in df.columns]
    parts = [F.transform(T.items(c), lambda x: F.struct(F.lit("issn").alias("kind"), T.issn(x).alias("key"))) for c in own[0]]
    parts += [F.array(F.struct(F.lit("name").alias("kind"), T.journal(c).alias("key"))) for c in own[1]]
    table = keys(metrics)
    size = F.octet_length("key") + F.octet_length(F.to_json("metric"))
    n, total = table.limit(BROADCAST_KEYS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= BROADCAST_KEYS and total <= BROADCAST_BYTES:
        table = F.broadcast(table)
    if not parts:
        return df.withColumn("metric", F.lit(None).cast(table.schema["metric"].dataType))
    cand = df.select("_ord", F.posexplode(F.concat(*parts)).alias("pos", "k")).select("_ord", "pos", F.col("k.kind").alias("kind"), F.col("k.key").alias("key")).where("key <> ''")
    hit = cand.join(table, ["kind", "key"]).groupBy("_ord").agg(F.min_by("metric", "pos").alias("metric"))
    return df.join(hit, "_ord", "left")


def general(x: Column) -> Column:
    """A number with six significant digits, without trailing zeros, in the shortest of plain and exponent form."""
    short = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    digits = F.floor(F.log10(F.abs(F.bround(x, 12)))).cast("int")
    out = F.when(x == 0, "0")
    for d in range(-4, 6):
        out = out.when(digits == d, short(F.format_string(f"%.{5 - d}f", x)))
    return out.otherwise(short(F.format_string("%.5e", x)))


def number(c) -> Column:
    """The double a text states; null if it is none."""
    x = F.lower(T.strip(c))
    return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), x.cast("double")).when(x.rlike(r"^[+-]?(inf|infinity)$"), F.when(x.startswith("-"), -float("inf")).otherwise(float("inf"))).when(x.rlike("^[+-]?nan$"), float("nan"))


def annotate(df: DataFrame, metrics: DataFrame, min_if: float | None = None) -> DataFrame:
    """Adds the metric of each row's journal, and with a threshold whether it is passed (strictly) and why."""
    out = match(df, metrics)
    known, value = F.col("metric").isNotNull(), number("metric.impact_factor")
    have = set(metrics.columns)
    cell = lambda c, missing: F.when(known, T.strip(f"metric.{c}") if c in have else F.lit("")).otherwise(missing)
    status, reason = F.when(known, F.lit("")).otherwise("unverified" if min_if is not None else ""), F.when(known, F.lit(""))
    if min_if is not None:
        least = F.lit(float(min_if))
        passed = F.coalesce((value > least) & ~F.isnan(value), F.lit(False))  # a value that is no number passes nothing
        text = F.concat(F.lit("Impact factor "), general(value), F.when(passed, " > ").otherwise(" <= "), general(least))
        status = F.when(~known | value.isNull(), "unverified").when(passed, "pass").otherwise("fail")
        reason = F.when(known & value.isNull(), "Metric value is not numeric").when(known, text)
    return out.withColumns({
        "journal_metric": cell("impact_factor", "Not verified"), "journal_metric_year": cell("metric_year", ""), "journal_metric_source": cell("metric_source", "Not available"),
        "journal_metric_url": cell("source_url", ""), "journal_metric_confidence": cell("confidence", ""), "journal_metric_verified": F.when(known, "true").otherwise("false"),
        "metric_filter_status": status, "metric_filter_reason": reason.otherwise("No matching verified metric record"),
    }).drop("metric")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pass, everything else)."""
    ok = T.strip("metric_filter_status") == "pass"
    return df.where(ok), df.where(~ok)


# Columns of a metric dimension, and those of them that may not be blank.
REQUIRED = ("journal", "aliases", "issn", "impact_factor", "metric_year", "metric_source", "source_url", "last_checked", "confidence")
GOVERNED = ("metric_year", "metric_source", "source_url", "last_checked", "confidence")


def _quoted(c: Column) -> Column:
    """A text in quotes, as messages show it."""
    x = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))


def governance(metrics: DataFrame, require_numeric=False) -> DataFrame:
    """Findings (level, row, field, message) on a dimension with _ord from 0; row is that of the file, whose header is row 1.

    Missing columns and values that are no numbers are errors; so is each change of the journal, as it is written, that owns a
    normalised name or ISSN, in the order of the rows. Blank fields are warnings; a row without a journal gives one and is
    not looked at further."""
    from pyspark.sql import Window as W

    have = set(metrics.columns)
    cell = lambda c: T.strip(c) if c in have else F.lit("")
    rows = metrics.select((F.col("_ord") + 2).alias("row"), *[cell(c).alias(c) for c in REQUIRED])
    at = F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(" "), F.col("journal"), F.lit(": "))
    finding = lambda level, field, message: F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), message.alias("message"))
    named, factor = F.col("journal") != "", F.col("impact_factor")
    checks = [(~named, finding("warning", "journal", F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(": journal is blank"))))]
    checks += [(named & (F.col(c) == ""), finding("warning", c, F.concat(at, F.lit(f"{c} is blank")))) for c in GOVERNED]
    asked = F.lit(True) if require_numeric else factor != ""
    checks.append((named & asked & number("impact_factor").isNull(), finding("error", "impact_factor", F.concat(at, F.lit("impact_factor is not numeric: "), _quoted(factor)))))
    own = rows.select("row", F.explode(T.compact(checks)).alias("f")).select("f.level", "row", "f.field", "f.message")
    keyed = lambda kind, values, key: F.transform(values, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), key(x).alias("key")))
    names = keyed("journal", F.concat(F.array("journal"), T.items("aliases")), T.journal)
    issns = keyed("issn", T.items("issn"), T.issn)
    owners = rows.where(named).select("row", "journal", F.explode(F.concat(names, issns)).alias("k")).select("row", "journal", "k.*").where("key <> ''")
    before = F.lag("journal").over(W.partitionBy("kind", "key").orderBy("row", "i"))
    clash = owners.withColumn("before", before).where("before <> journal")
    label = F.when(F.col("kind") == "issn", "ISSN ").otherwise("normalized journal name ")
    both = clash.select(F.lit("error").alias("level"), "row", F.col("kind").alias("field"), F.concat(label, _quoted(F.col("key")), F.lit(" maps to both "), _quoted(F.col("before")), F.lit(" and "), _quoted(F.col("journal"))).alias("message"))
    lost = [c for c in REQUIRED if c not in have]
    header = metrics.sparkSession.createDataFrame([("error", 1, "", f"missing required columns: {', '.join(lost)}")] if lost else [], "level string, row long, field string, message string")
    return header.unionByName(own).unionByName(both)


def governance_status(findings: DataFrame) -> DataFrame:
    """One row: n_errors, n_warnings and error, warning or ok."""
    errors, warnings = F.count_if(F.col("level") == "error"), F.count_if(F.col("level") == "warning")
    return findings.agg(errors.alias("n_errors"), warnings.alias("n_warnings"), F.when(errors > 0, "error").when(warnings > 0, "warning").otherwise("ok").alias("status"))
