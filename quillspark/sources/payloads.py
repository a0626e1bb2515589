"""Captured provider payloads (JSON, Atom XML) flattened to candidate columns. Input: one payload text per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

WORK = "STRUCT<id STRING, doi STRING, title STRING, publication_year INT, type STRING, authorships ARRAY<STRUCT<author: STRUCT<display_name STRING>>>, primary_location STRUCT<landing_page_url STRING, source STRUCT<display_name STRING>>, abstract_inverted_index MAP<STRING, ARRAY<INT>>>"
PAPER = "STRUCT<paperId STRING, title STRING, year INT, venue STRING, abstract STRING, url STRING, journal STRUCT<name STRING>, externalIds STRUCT<DOI STRING>, publicationTypes ARRAY<STRING>, authors ARRAY<STRUCT<name STRING>>>"
CROSSREF = "STRUCT<message: STRUCT<DOI STRING, title ARRAY<STRING>, `container-title` ARRAY<STRING>, publisher STRING, type STRING, ISSN ARRAY<STRING>, issued STRUCT<`date-parts` ARRAY<ARRAY<INT>>>, created STRUCT<`date-parts` ARRAY<ARRAY<INT>>>, `published-print` STRUCT<`date-parts` ARRAY<ARRAY<INT>>>, `published-online` STRUCT<`date-parts` ARRAY<ARRAY<INT>>>>>"
OA = "STRUCT<doi STRING, is_oa BOOLEAN, oa_status STRING, doi_url STRING, best_oa_location STRUCT<url STRING, url_for_landing_page STRING, url_for_pdf STRING, license STRING, version STRING, host_type STRING, evidence STRING, repository_institution STRING>, oa_locations ARRAY<STRUCT<url STRING>>>"
ATOM = "entry ARRAY<STRUCT<id STRING, title STRING, summary STRING, published STRING, author ARRAY<STRUCT<name STRING>>, link ARRAY<STRUCT<_href STRING, _rel STRING, _type STRING, _title STRING>>, `arxiv:doi` STRING, `arxiv:journal_ref` STRING, category ARRAY<STRUCT<_term STRING>>>>"


def _names(a) -> Column:
    return F.array_join(F.filter(a, lambda x: T.strip(x) != ""), "; ")


def rebuild_abstract(index) -> Column:
    """Text of an inverted index: dense positions, gaps empty, a later word wins a contested position."""
    words = F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w"))))

    def spaced(a):
        last = F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)["p"] != x["p"], F.lit(True)))
        return T.once(last, lambda b: F.array_join(F.transform(b, lambda x, i: F.concat(F.repeat(F.lit(" "), x["p"] - F.coalesce(F.get(b, i - 1)["p"], F.lit(0))), x["w"])), ""))

    return F.coalesce(T.once(F.array_sort(F.flatten(words)), spaced), F.lit(""))


def inverted_index(words) -> Column:
    """Map of each word of an array to its positions: one sort by word and position, then one pass over the runs of a word."""

    def runs(a):
        n = F.size(a)
        begin = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(a, i)["w"] != F.get(a, i - 1)["w"]))
        entry = lambda b: lambda i, k: F.struct(F.get(a, i)["w"].alias("w"), F.transform(F.slice(a, i + 1, F.coalesce(F.get(b, k + 1), n) - i), lambda x: x["p"]).alias("p"))
        return F.map_from_entries(T.once(begin, lambda b: F.transform(b, entry(b))))

    pairs = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p")))
    return F.when(F.size(words) > 0, T.once(F.array_sort(pairs), runs))


def openalex(df: DataFrame, column="payload") -> DataFrame:
    r = df.select(*[c for c in df.columns if c != column], F.posexplode(F.from_json(column, f"STRUCT<results: ARRAY<{WORK}>>")["results"]).alias("pos", "w"))
    return r.select(*[c for c in r.columns if c not in ("w",)], T.text("w.title").alias("title"), T.doi("w.doi").alias("doi"), T.text(F.col("w.publication_year").cast("string")).alias("publication_year"), T.text("w.primary_location.source.display_name").alias("journal"), T.text("w.type").alias("article_type"), _names(F.transform("w.authorships", lambda a: a["author"]["display_name"])).alias("authors"), F.coalesce(rebuild_abstract("w.abstract_inverted_index"), F.lit("")).alias("abstract"), T.first_filled("w.primary_location.landing_page_url", "w.doi", "w.id").alias("landing_page_url"))


def semantic_scholar(df: DataFrame, column="payload") -> DataFrame:
    r = df.select(*[c for c in df.columns if c != column], F.posexplode(F.from_json(column, f"STRUCT<data: ARRAY<{PAPER}>>")["data"]).alias("pos", "w"))
    return r.select(*[c for c in r.columns if c != "w"], T.text("w.title").alias("title"), F.lower(F.trim(T.text("w.externalIds.DOI"))).alias("doi"), T.text(F.col("w.year").cast("string")).alias("publication_year"), T.first_filled("w.venue", "w.journal.name").alias("journal"), F.array_join(F.coalesce("w.publicationTypes", F.array().cast("array<string>")), ";").alias("article_type"), _names(F.transform("w.authors", lambda a: a["name"])).alias("authors"), T.text("w.abstract").alias("abstract"), T.text("w.url").alias("landing_page_url"))


def date_parts(m: str) -> tuple[Column, Column]:
    """(year, date text) of the first filled of issued, created, print and online; parts joined with -, not padded."""
    parts = F.coalesce(*[F.get(F.col(f"{m}.`{k}`.`date-parts`"), F.lit(0)) for k in ("issued", "created", "published-print", "published-online")])
    return T.text(F.get(parts, F.lit(0)).cast("string")), F.coalesce(F.array_join(F.filter(parts, lambda x: x.isNotNull()), "-"), F.lit(""))


def crossref(df: DataFrame, column="payload") -> DataFrame:
    r = df.withColumn("m", F.from_json(column, CROSSREF)["message"])
    year, date = date_parts("m")
    first = lambda c: T.text(F.get(F.col(c), F.lit(0)))
    return r.select(*[c for c in df.columns if c != column], T.doi("m.DOI").alias("doi"), T.strip_tags(first("m.title")).alias("title"), first("m.`container-title`").alias("journal"), T.text("m.publisher").alias("publisher"), T.text("m.type").alias("type"), F.coalesce(F.array_join("m.ISSN", "; "), F.lit("")).alias("issn"), year.alias("year"), date.alias("date"))


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    """Part of a variant; null where it is absent or of another kind."""
    return F.try_variant_get(v, f"$.{path}", kind)


#: JSON of blank variants: null, an empty text, list or object, 0 or false.
_BLANK = ("null", '""', "[]", "{}", "0", "false")


def _is(v: Column, mark: str) -> Column:
    """Is the variant a list ([) or an object ({)?"""
    return F.coalesce(F.to_json(v).startswith(mark), F.lit(False))


def _listed(v: Column) -> Column:
    """A variant as a list of variants: its own items, or itself alone, or nothing."""
    own = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(F.when(_is(v, "["), own).when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))


def crossref_authority(df: DataFrame, column="payload") -> DataFrame:
    """Captured works as authority rows: doi, title, journal, publisher, type, year, issn (the first), url, created, published; all other columns stay."""
    m = F.try_parse_json(F.col(column))
    v = lambda path: _at(F.col("m"), f"message.{path}")
    text = lambda path: T.text(F.try_variant_get(F.col("m"), f"$.message.{path}", "string"))
    head = lambda path: T.strip(F.try_variant_get(F.get(_listed(v(path)), F.lit(0)), "$", "string"))

    def parts(path):
        return F.get(F.try_variant_get(F.col("m"), f"$.message['{path}']['date-parts']", "array<array<string>>"), F.lit(0))

    date = lambda x: F.coalesce(F.array_join(F.filter(x, lambda p: p.isNotNull()), "-"), F.lit(""))
    year = T.first_filled(*[F.when(~F.get(parts(k), F.lit(0)).isin("", "0"), F.get(parts(k), F.lit(0))) for k in ("issued", "created", "published-print", "published-online")])
    published = date(F.coalesce(parts("published-print"), parts("published-online")))
    rows = df.withColumn("m", m).where(v("DOI").isNotNull() | v("title").isNotNull())
    cells = {"doi": T.doi(text("DOI")), "title": head("title"), "journal": head("['container-title']").alias("journal"), "publisher": text("publisher"), "type": text("type"), "year": year, "issn": head("ISSN"), "url": text("URL"), "created": date(parts("created")), "published": published}
    return rows.select(*[c for c in df.columns if c not in (column, *cells)], *[c.alias(n) for n, c in cells.items()])


def europe_pmc(df: DataFrame, column="payload") -> DataFrame:
    """Records as candidate rows. Publication types, full-text links and dates may be a text, an object or a list.

    What several cells read is a column of an earlier step, so that every part of a record is read and cleaned once."""
    records = F.try_variant_get(F.try_parse_json(F.col(column)), "$.resultList.result", "array<variant>")
    r = df.select(*[c for c in df.columns if c != column], F.posexplode(records).alias("pos", "w"))
    keep, c = [x for x in r.columns if x != "w"], lambda k: F.col(f"c.{k}")
    texts = ("title", "journalTitle", "abstractText", "citedByCount", "authorString", "pmcid", "isOpenAccess", "hasFullText", "inEPMC", "source", "id", "doi", "pmid", "pubYear", "yearOfPublication")
    dates = ("firstPublicationDate", "electronicPublicationDate", "journalInfo")
    parts = {"pubType": "pubType", "pubTypeList": "pubTypeList", "links": "fullTextUrlList.fullTextUrl"} | {k: k for k in dates}
    r = r.select(*keep, F.struct(*[T.clean(_at(F.col("w"), k, "string")).alias(k) for k in texts]).alias("c"), *[_at(F.col("w"), path).alias(f"v_{k}") for k, path in parts.items()])
    v = lambda k: F.col(f"v_{k}")
    r = r.withColumns({"j_pubType": F.to_json(v("pubType")), "j_pubTypeList": F.to_json(v("pubTypeList")), "l_links": _listed(v("links"))})
    filled = lambda k: F.when(~F.coalesce(F.col(f"j_{k}"), F.lit("null")).isin(*_BLANK), F.struct(v(k).alias("v"), F.col(f"j_{k}").alias("j")))
    r = r.withColumn("k", F.coalesce(filled("pubType"), filled("pubTypeList")))
    r = r.withColumn("kinds", F.when(F.coalesce(F.col("k.j").startswith("{"), F.lit(False)), _at(F.col("k.v"), "pubType")).otherwise(F.col("k.v")))
    r = r.withColumn("kinds", _listed(F.col("kinds")))
    types = F.array_join(F.filter(F.transform("kinds", lambda x: T.clean(F.try_variant_get(x, "$", "string"))), lambda x: x != ""), ";")
    urls = F.filter(F.transform("l_links", lambda u: F.struct(_at(u, "url", "string").alias("url"), _at(u, "availabilityCode", "string").alias("code"))), lambda u: T.text(u["url"]) != "")
    either = lambda k: F.when(_is(v(k), "{"), T.first_filled(_at(v(k), "printPublicationDate", "string"), _at(v(k), "dateOfPublication", "string"))).otherwise(F.try_variant_get(v(k), "$", "string"))
    r = r.select(*keep, "c", types.alias("types"), urls.alias("urls"), *[T.clean(either(k)).alias(f"d_{k}") for k in dates], T.doi(c("doi")).alias("doi"))
    year = F.coalesce(*[F.when(F.length(x) >= 4, F.substring(x, 1, 4)) for x in (c("pubYear"), c("yearOfPublication"), *[F.col(f"d_{k}") for k in dates])], F.lit(""))
    best = F.coalesce(F.get(F.filter("urls", lambda u: u["code"] == "OA"), F.lit(0))["url"], F.get("urls", F.lit(0))["url"], F.lit(""))
    source, own, doi = c("source"), c("id"), F.col("doi")
    pmid = F.when(c("pmid") != "", c("pmid")).when(F.upper(source) == "MED", own).otherwise("")
    landing = F.when((source != "") & (own != ""), F.concat(F.lit("https://europepmc.org/article/"), _quoted(source), F.lit("/"), _quoted(own))).when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")
    r = r.withColumn("landing", landing)
    note = F.concat(F.lit("source="), source, F.lit("; isOpenAccess="), c("isOpenAccess"), F.lit("; hasFullText="), c("hasFullText"), F.lit("; inEPMC="), c("inEPMC"))
    cells = {
        "title": c("title"), "doi": doi, "publication_year": year, "journal": c("journalTitle"), "abstract": c("abstractText"), "article_type": F.col("types"), "cited_by_count": c("citedByCount"), "authors": F.regexp_replace(c("authorString"), r"\.+$", ""),
        "landing_page_url": F.col("landing"), "url": F.col("landing"), "best_full_text_url": best, "pmid": pmid, "pmcid": c("pmcid"), "europe_pmc_id": F.when((source != "") & (own != ""), F.concat(source, F.lit(":"), own)).otherwise(own), "discovery_source": F.lit("europe_pmc"), "source_note": note,
    }
    return r.select(*keep, *[x.alias(n) for n, x in cells.items()])


def _quoted(c: Column) -> Column:
    """Percent-encoded part of a path; / stays."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))


def open_access(df: DataFrame, column="payload", status="status", checked_at: str = "") -> DataFrame:
    """The 16 columns of an open-access response (status and error as captured); they follow the other columns of df."""
    cell = lambda c: T.text(F.col(c).cast("string")) if c in df.columns else F.lit("")
    r = df.withColumn("o", F.from_json(column, OA))
    known = F.col(column).isNotNull() & F.col("o").isNotNull() & (cell(status) == "ok")
    one = lambda c: F.when(known, T.text(F.col(f"o.{c}").cast("string"))).otherwise("")
    best = lambda c: one(f"best_oa_location.{c}")
    cols = {
        "unpaywall_status": cell(status), "unpaywall_error": cell("error"), "unpaywall_retry_after_seconds": cell("retry_after_seconds"), "unpaywall_checked_at": F.lit(checked_at),
        "is_oa": F.when(known, F.coalesce(F.col("o.is_oa"), F.lit(False)).cast("string")).otherwise(""), "oa_status": one("oa_status"), "oa_locations_count": F.when(known, F.coalesce(F.size("o.oa_locations"), F.lit(0)).cast("string")).otherwise(""),
        "best_oa_url": best("url"), "best_oa_landing_url": best("url_for_landing_page"), "best_oa_pdf_url": best("url_for_pdf"), "best_oa_host_type": best("host_type"), "best_oa_version": best("version"), "best_oa_license": best("license"),
        "best_oa_evidence": best("evidence"), "best_oa_repository_institution": best("repository_institution"), "unpaywall_doi_url": one("doi_url"),
    }
    return r.select(*[c for c in df.columns if c not in (column, status, "error", "retry_after_seconds", *cols)], *[c.alias(n) for n, c in cols.items()])


def open_access_annotate(df: DataFrame, responses: DataFrame, email: str = "", checked_at: str = "", most: int | None = None) -> DataFrame:
    """Rows (with _ord) and their open-access columns. responses: doi, status, payload and optionally error, retry_after_seconds.

    Rows beyond ``most`` are marked as over the budget, those without a DOI as missing it; without an e-mail address nothing is asked."""
    doi = T.doi(T.first_filled(*[c for c in ("crossref_doi", "doi") if c in df.columns]))
    flat = open_access(responses.select(T.doi("doi").alias("_k"), *[c for c in responses.columns if c != "doi"]), checked_at=checked_at)
    made = [c for c in flat.columns if c != "_k"]
    one = flat.groupBy("_k").agg(F.min(F.struct(*made)).alias("_r"))
    over = (F.col("_ord") >= most) if most is not None else F.lit(False)
    own = F.when(over, "skipped_budget").when(F.col("_d") == "", "missing_doi").when(F.lit(not email), "skipped_missing_email")
    rows = df.drop(*made).withColumn("_d", doi).join(one, F.col("_d") == F.col("_k"), "left")
    cols = {c: F.when(own.isNull(), T.text(f"_r.{c}")).otherwise("") for c in made}
    cols["unpaywall_status"] = F.coalesce(own, F.when(F.col("_r").isNull(), "not_found").otherwise(F.col("_r.unpaywall_status")))
    cols["unpaywall_error"] = F.when(over, "").when(F.col("_d") == "", "DOI is missing").when(F.lit(not email), "no e-mail address is set").when(F.col("_r").isNull(), "DOI not found").otherwise(T.text("_r.unpaywall_error"))
    cols["unpaywall_checked_at"] = F.lit(checked_at)
    return rows.select(*[c for c in df.columns if c not in made], *[c.alias(n) for n, c in cols.items()])


def arxiv(df: DataFrame, column="payload") -> DataFrame:
    r = df.select(*[c for c in df.columns if c != column], F.posexplode(F.from_xml(F.col(column), ATOM)["entry"]).alias("pos", "e"))
    links = F.coalesce("e.link", F.array().cast("array<struct<_href:string,_rel:string,_type:string,_title:string>>"))
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1))["_href"], F.lit(""))
    arxiv_id = F.element_at(F.split(T.text("e.id"), "/abs/"), -1)
    return r.select(*[c for c in r.columns if c != "e"], arxiv_id.alias("arxiv_id"), T.squeeze(F.col("e.title")).alias("title"), T.doi("e.`arxiv:doi`").alias("doi"), F.substring(T.text("e.published"), 1, 4).alias("publication_year"), T.first_filled("e.`arxiv:journal_ref`").alias("journal"), T.squeeze(F.col("e.summary")).alias("abstract"), _names(F.transform("e.author", lambda a: a["name"])).alias("authors"), F.array_join(F.transform("e.category", lambda c: c["_term"]), "; ").alias("categories"), last(F.filter(links, lambda x: x["_rel"] == "alternate")).alias("landing_page_url"), last(F.filter(links, lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf"))).alias("pdf_url"), F.lit("preprint").alias("article_type"))


READERS = {"openalex": openalex, "semantic_scholar": semantic_scholar, "arxiv": arxiv, "europe_pmc": europe_pmc}
# Accepted spellings of provider names.
ALIASES = {"s2": "semantic_scholar", "semanticscholar": "semantic_scholar", "europepmc": "europe_pmc", "epmc": "europe_pmc", "open_alex": "openalex"}


def providers(names: str | list[str] | None) -> list[str]:
    """Ordered distinct provider names; aliases resolved, unknown ones rejected."""
    given = names.split(",") if isinstance(names, str) else list(names or ["openalex"])
    out = []
    for x in given:
        key = x.strip().lower().replace("-", "_")
        key = ALIASES.get(key, key)
        if key and key not in READERS:
            raise ValueError(f"unknown provider {x!r}")
        if key and key not in out:
            out.append(key)
    return out or ["openalex"]


def read(provider: str, df: DataFrame, column="payload", year_from: int | None = None, year_to: int | None = None, most: int | None = None, types=None) -> DataFrame:
    """Rows of a provider's captured pages (payload, and _ord for the order of pages), as a search would return them.

    Repeated papers are left out (the first stays; rows without a key all stay), years outside the bounds go where the
    provider cannot filter them itself, OpenAlex types not in ``types`` go, and at most ``most`` rows stay, in order."""
    if provider not in READERS:
        raise ValueError(f"unknown provider {provider!r}")
    rows = READERS[provider](df, column)
    rows = rows.select(F.inline(F.array(F.struct(*rows.columns))))  # filters stay behind the generator: cells are computed once, not again in each condition
    key = {"arxiv": T.text("arxiv_id"), "europe_pmc": T.first_filled("doi", *(["pmid"] if "pmid" in rows.columns else []), "title")}.get(provider) if provider in ("arxiv", "europe_pmc") else T.text("doi")
    if types and provider == "openalex" and not {"*", "all", "none"} & set(types):
        rows = rows.where(T.text("article_type").isin(*types))
    if provider in ("arxiv", "europe_pmc") and (year_from is not None or year_to is not None):
        y = F.regexp_extract(T.strip("publication_year"), r"^\d{4}", 0).try_cast("int")
        rows = rows.where(y.isNull() | y.between(year_from if year_from is not None else 0, year_to if year_to is not None else 9999))
    # one pass: rows without a key are grouped by their place, so that each of them stays
    order, keyed, row = F.struct("_ord", "pos"), rows.withColumn("_key", key), F.struct(*rows.columns)
    none = F.col("_key") == ""
    groups = keyed.groupBy("_key", F.when(none, order).alias("_at")).agg(F.min_by(row, order).alias("r"), F.collect_list(F.when(none, row)).alias("all"))
    rows = groups.select(F.inline(F.when(none, F.col("all")).otherwise(F.array("r"))))
    return rows if most is None else rows.orderBy("_ord", "pos").limit(most)


def read_many(provider: str, df: DataFrame, column="payload", **options) -> DataFrame:
    """Rows of several queries' pages (query_id, _ord, payload): papers are distinct over all queries, the first query keeps them."""
    return read(provider, df, column, **options)


def capabilities(spark) -> DataFrame:
    """The registry: provider, role, alias names, and whether it can be searched for discovery."""
    rows = [(p, "discovery", sorted(a for a, n in ALIASES.items() if n == p), True) for p in READERS] + [("crossref", "verification", [], False), ("unpaywall", "open access", [], False)]
    return spark.createDataFrame(rows, "provider string, role string, aliases array<string>, discovery boolean")
