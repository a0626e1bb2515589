"""Text and identifier functions: Column in, Column out. Missing is the empty string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

DOI = r"^10\.\d{4,9}/\S+$"


def lit(x):
    return F.lit(x)


def text(c) -> Column:
    """Cell as text: null becomes empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim all white space, Unicode white space included; one run to the end and back instead of a search at every place."""
    return F.regexp_extract(text(c), r"(?sU)\A\s*+(.*\S)", 1)


def first_filled(*cols) -> Column:
    """First value that is not empty."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cols], F.lit(""))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(text(c), r"(?U)\s(?:(?<! )\s*+|\s++)", " "))  # single blanks stay as they are


def doi(c) -> Column:
    """Normalised DOI: lower case, no resolver or doi: prefix, no trailing punctuation.

    A closing bracket at the end goes only if the text opens none of its kind."""
    x = strip(F.regexp_replace(F.lower(strip(c)), r"^(https?://(dx\.)?doi\.org/|doi:)", ""))

    def ended(v):
        def tail(marks: str) -> Column:
            return F.regexp_replace(v, rf"(?U)[{marks}\s]*[{marks}]$", "")

        rounded, square = F.contains(v, lit("(")), F.contains(v, lit("["))
        return F.when(rounded & square, tail(".,;")).when(rounded, tail(".,;\\]")).when(square, tail(".,;)")).otherwise(tail(".,;)\\]"))

    return once(x, lambda v: strip(ended(v)))


def once(value: Column, f) -> Column:
    """f(value) with value computed once, so expressions that use it often stay small."""
    return F.element_at(F.transform(F.array(value), f), 1)


def title(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def plain(c) -> Column:
    """Text for concepts: tags out, subscript digits to ASCII, Greek mu to u, white space collapsed."""
    x = F.regexp_replace(text(c), "<[^>]+>", " ")
    return squeeze(F.when((F.octet_length(text(c)) != F.length(text(c))) & text(c).rlike("[₀-₉μ]"), F.translate(x, "₀₁₂₃₄₅₆₇₈₉μ", "0123456789u")).otherwise(x))


def journal(c) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "&amp;|&", " and "), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(the|journal|of)\b", " "), " +", " "))


def issn(c) -> Column:
    return F.regexp_replace(F.upper(text(c)), "[^0-9X]", "")


def items(c) -> Column:
    """Split at | or ;, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text(c), r"[|;]"), lambda x: F.trim(x)), lambda x: x != "")


def slug(c, default="concept") -> Column:
    x = F.substring(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 50)
    return F.when(x == "", default).otherwise(x)


def safe_name(c) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.when(doi(c) != "", doi(c)).otherwise(F.lower(text(c))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(x == "", "unknown").otherwise(x)


def article_type(c) -> Column:
    return F.translate(F.lower(strip(c)), "_ ", "--")


def year(*cols) -> Column:
    """First field with a 19xx or 20xx token, as int; null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text(c), r"\b((?:19|20)\d{2})\b", 1), F.lit("")) for c in cols]).cast("int")


def find_doi(*cols) -> Column:
    hits = [F.nullif(doi(F.regexp_extract(text(c), r"(?i)(10\.\d{4,9}/[^\s\"'<>]+)", 1)), F.lit("")) for c in cols]
    return F.coalesce(*hits, F.lit(""))


def strip_tags(c) -> Column:
    """Tags out and the common entities unescaped."""
    x = F.regexp_replace(text(c), "<[^>]+>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, lit(a), lit(b))
    return squeeze(x)


def clean(c) -> Column:
    """Provider text: tags out without a trace, the common entities unescaped, white space collapsed."""
    return strip_tags(F.regexp_replace(text(c), "<[^>]+>", ""))


def domain(c) -> Column:
    return F.regexp_replace(F.lower(text(c)), r"^www\.", "")


def truncate(c, n: int) -> Column:
    """Longer texts keep n - 1 characters, right-trimmed, and end in three dots."""
    x = text(c)
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 1)), lit("..."))).otherwise(x)


def compact(pairs: list[tuple[Column, Column]]) -> Column:
    """Array of the values whose condition holds, in order."""
    return F.filter(F.array(*[F.when(cond, value) for cond, value in pairs]), lambda x: x.isNotNull())


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def first_number(c, default=0.0) -> Column:
    """Plain decimal text as double, otherwise the default."""
    x = strip(c)
    return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.cast("double")).otherwise(F.lit(default))
