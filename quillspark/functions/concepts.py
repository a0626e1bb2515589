"""Concepts: text predicates with negation, boolean operators and proximity, compiled to one Column."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from .text import any_of, once, plain, text

NEAR_WINDOW, LONGEST_PATTERN = 8, 300
# What negates a match when it stands before it with at most six words between.
NEGATORS = ("without", "no", "not", "absence of", "lack of", "lacking", "does not", "did not", "free of")
_NEGATED = r"(?iU)\b(?:" + "|".join(NEGATORS) + r")\b(?:\W+\w+){0,6}\W*$"
# Fields of each scope, in order.
_SCOPES = {
    "title": ("title", "crossref_title"),
    "abstract": ("abstract", "summary"),
    "article_type": ("article_type", "crossref_type"),
    "metadata": ("title", "crossref_title", "abstract", "summary", "journal", "crossref_container", "article_type", "crossref_type", "keywords"),
    "title_abstract": ("title", "crossref_title", "abstract", "summary", "keywords"),
}


@dataclass(frozen=True)
class Concept:
    name: str
    op: str = "patterns"
    patterns: tuple[str, ...] = ()
    children: tuple["Concept", ...] = ()
    scope: str = "title_abstract"
    weight: float | None = None
    window: int = NEAR_WINDOW


@dataclass(frozen=True)
class Profile:
    required: tuple[Concept, ...] = ()
    optional: tuple[Concept, ...] = ()
    negative: tuple[Concept, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    exclude_article_types: tuple[str, ...] = ()
    require_doi: bool = False
    allow_regex: bool = False
    weights: dict = field(default_factory=lambda: {"required": 3.0, "optional": 1.0, "negative": -2.0}, hash=False, compare=False)


def _slug(x: str) -> str:
    return re.sub("[^a-zA-Z0-9]+", "_", x.strip().lower()).strip("_")[:50] or "concept"


def _terms(x) -> tuple[str, ...]:
    """Terms of a list, or of a text that is split at | and ; (all of it where that leaves none)."""
    if isinstance(x, list):
        return tuple(s for s in (str(v).strip() for v in x) if s)
    return tuple(s for s in map(str.strip, re.split("[|;]", x)) if s) or (x,)


def parse_spec(spec: str) -> Concept:
    """``name=term|term`` (or with a colon), a bare list of terms, or a JSON object. A name without terms is a concept of the empty term, which every text has."""
    spec = (spec or "").strip()
    if not spec:
        raise ValueError("empty concept specification")
    if spec.startswith("{") and isinstance(given := _parsed(spec), dict):
        return from_object(given)
    at = min((i for i in (spec.find("="), spec.find(":")) if i > 0), default=-1)
    rest = spec[at + 1 :].strip() if at > 0 else spec
    terms = _terms(rest)
    return Concept(_slug(spec[:at] if at > 0 else terms[0]), patterns=terms)


def _parsed(text: str):
    """A text that looks like JSON and is, else the text."""
    if text.strip()[:1] not in ("{", "["):
        return text
    try:
        return json.loads(text)
    except ValueError:
        return text


def _children(x) -> tuple[Concept, ...]:
    return tuple(from_object(v) for v in (x if isinstance(x, list) else [] if x is None else [x]))


def from_object(obj) -> Concept:
    """all_of, any_of, not, near, not_near or plain terms, in this order of precedence; name or label names it.

    near takes a text (terms at commas, | and ;), a list, or an object of terms and window."""
    obj = _parsed(obj) if isinstance(obj, str) else obj
    if isinstance(obj, str):
        return parse_spec(obj)
    if not isinstance(obj, dict):
        raise ValueError(f"a concept is a text or an object, not {type(obj).__name__}")
    same = {"name": _slug(str(obj.get("name") or obj.get("label") or "concept")), "scope": str(obj.get("scope") or "title_abstract"), "weight": float(obj["weight"]) if "weight" in obj else None}
    window = lambda x: max(1, int(x.get("window") or NEAR_WINDOW))
    op = next((k for k in ("all_of", "any_of", "not", "near", "not_near") if k in obj), "")
    if op in ("all_of", "any_of", "not"):
        kids = _children(obj[op])
        if not kids:
            raise ValueError(f"concept {same['name']!r} has nothing in {op}")
        return Concept(op=op.removesuffix("_of"), children=kids, window=window(obj), **same)
    if op:
        own = obj[op]
        at = own if isinstance(own, dict) else obj
        own = own.get("terms") if isinstance(own, dict) else own
        if not isinstance(own, (str, list)):
            raise ValueError(f"{op} of concept {same['name']!r} is neither a text nor a list")
        terms = _terms(own.replace(",", "|") if isinstance(own, str) else own)
        if len(terms) < 2:
            raise ValueError(f"{op} of concept {same['name']!r} needs two terms or more")
        return Concept(op=op, patterns=terms, window=window(at), **same)
    own = next((obj[k] for k in ("patterns", "terms", "term") if k in obj), [])
    terms = _terms(own) if isinstance(own, (str, list)) else ()
    if not terms:
        raise ValueError(f"concept {same['name']!r} has no terms")
    return Concept(patterns=terms, **same)


def load_profile(text: str | None = None, required=(), optional=(), negative=(), year_from=None, year_to=None, require_doi=False, exclude_article_types=(), allow_regex=False) -> Profile:
    """Profile of a JSON text and of the caller's specs, which come after those of the text; the caller's years win."""
    data = json.loads(text) if text else {}
    hard = data.get("hard_filters") if isinstance(data.get("hard_filters"), dict) else {}
    groups = {}
    for name, more in (("required", required), ("optional", optional), ("negative", negative)):
        groups[name] = tuple(from_object(x) for x in [*data.get(name, data.get(f"{name}_concepts", [])), *more])
    whole = lambda own, key: int(str(v)) if (v := own if own is not None else hard.get(key)) not in (None, "") else None
    kind = lambda x: str(x).strip().lower().replace("_", "-")
    types = [kind(x) for x in data.get("exclude_article_types", hard.get("exclude_article_types", []))]
    types += [kind(x) for given in exclude_article_types for x in re.split("[,;|]", given) if x.strip()]
    return Profile(**groups, year_from=whole(year_from, "year_from"), year_to=whole(year_to, "year_to"), exclude_article_types=tuple(dict.fromkeys(types)), require_doi=bool(require_doi or hard.get("require_doi", False)), allow_regex=allow_regex)


def scoped(columns, scope: str) -> Column:
    fields = _SCOPES.get((scope or "").lower(), _SCOPES["title_abstract"])
    have = set(columns)
    parts = [text(f) for f in fields if f in have]
    return plain(F.concat_ws(" ", *parts)) if parts else F.lit("")


def java_pattern(term: str, allow_regex: bool = False) -> str:
    """Case-insensitive Java pattern of a term; ``re:`` is a raw expression where allowed."""
    term = re.sub("<[^>]+>", " ", term).strip()
    if len(term) > LONGEST_PATTERN:
        raise ValueError("pattern too long")
    if term.startswith("re:"):
        if not allow_regex:
            raise ValueError("raw regular expressions are not enabled")
        return "(?iU)" + term[3:]
    body = r"\s+".join(re.escape(w) for w in term.split())
    return "(?iU)" + (rf"\b{body}\b" if re.fullmatch(r"[A-Za-z0-9_\s-]+", term) else body)


def basic_match(x: Column, pattern: str, raw: bool = False) -> Column:
    """Some match whose 80 characters before it do not end in a negator and at most six words. The empty pattern matches every text.

    Mostly the first match is such a one; all of them are looked at only where it is not (and for raw expressions, whose groups may have numbers)."""
    if pattern == "(?iU)":
        return F.lit(True)
    parts = F.struct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)).alias("hits"), F.split(x, pattern, -1).alias("gaps"))

    def free(s: Column) -> Column:
        def step(acc, j):
            before = F.right(F.concat(acc["tail"], F.get(s["gaps"], j)), F.lit(80))
            hit = acc["ok"] | ~before.rlike(_NEGATED)
            return F.struct(F.right(F.concat(before, F.get(s["hits"], j)), F.lit(80)).alias("tail"), hit.alias("ok"))

        return F.aggregate(F.sequence(F.lit(0), F.size(s["hits"]) - 1), F.struct(F.lit("").alias("tail"), F.lit(False).alias("ok")), step)["ok"]

    first = F.lit(False) if raw else ~F.right(F.regexp_extract(x, rf"(?s)\A(.*?)(?-s:{pattern})", 1), F.lit(80)).rlike(_NEGATED)
    return F.when(x.rlike(pattern), F.when(first, True).otherwise(once(parts, free))).otherwise(False)


def _where(tokens: Column, at: Column, phrase: Column, n: int) -> Column:
    return F.filter(at, lambda p: F.slice(tokens, p, n) == phrase)


def near_match(x: Column, terms, window: int) -> Column:
    """One position of each term within a window of word positions; negation plays no part."""
    own = [re.findall("[a-z0-9]+", t.lower()) for t in terms]

    def groups(tokens: Column) -> Column:
        at = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))
        return F.array(*[_where(tokens, at, F.array(*map(F.lit, t)), len(t)) for t in own])

    def close(g: Column) -> Column:
        def starts(p):
            return ~any_of(~F.exists(F.get(g, F.lit(i)), lambda q: (q >= p) & (q <= p + window)) for i in range(len(own)))

        return any_of(F.exists(F.get(g, F.lit(i)), starts) for i in range(len(own)))

    return once(once(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), groups), close)


def scopes(concepts) -> set[str]:
    """Scopes that the concepts and their parts read."""
    return {s for c in concepts for s in ({c.scope} if not c.children else scopes(c.children))}


def matches(concept: Concept, columns, allow_regex: bool = False, texts: dict[str, Column] | None = None) -> Column:
    """Does the concept hold? texts may have the text of each scope as a column, computed once for all concepts."""
    if concept.op in ("all", "any", "not"):
        kids = [matches(k, columns, allow_regex, texts) for k in concept.children]
        if concept.op == "all":
            return ~any_of(~k for k in kids)
        return any_of(kids) if concept.op == "any" else ~any_of(kids)
    x = (texts or {}).get(concept.scope)
    x = scoped(columns, concept.scope) if x is None else x
    if concept.op == "near":
        return (x != "") & near_match(x, concept.patterns, concept.window)
    if concept.op == "not_near":
        return (x != "") & ~near_match(x, concept.patterns, concept.window)
    return (x != "") & any_of(basic_match(x, java_pattern(p, allow_regex), re.sub("<[^>]+>", " ", p).strip().startswith("re:")) for p in concept.patterns)
