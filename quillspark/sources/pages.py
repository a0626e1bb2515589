"""Captured provider pages as a Spark data source: ``spark.read.format("captured_pages")``.

A capture is one response a file, ``<path>/<provider>/<query id>/page-<n>.json`` (``.xml`` for Atom); ``page-<n>.error.json``
holds what ended a query: status, error, http_status, transient, retry_after_seconds. Folders that Spark wrote as
``provider=/query=/page=/part-*`` with a line of text each are read too. A task reads whole queries,
since paging is sequential: pages in order until one is empty or short, the provider's page limit or ``max_results`` is
reached. Rows are records (one JSON or XML text each) with their year and type beside them, so filters on provider, query,
page, year and type can be pushed into the reader: provider and query leave out whole partitions, the others records that then
never reach the JVM. ``search`` flattens records with the readers of ``payloads``.

Spark keeps one reader for a loaded table and all plans over it, so filters of one plan would reach another (seen with Spark 4.1: two
filters over one table in a union). Therefore only filters that ``load`` itself puts on the table (``only``) are taken; every plan
has them. Others stay with Spark.

Options: path (of any file system that pyarrow reads), providers (comma list, else all there are), max_results, semantic_max_results, year_from,
year_to, types (comma list), fields (top-level names that JSON records keep; else all), what (``records`` or ``calls``: a row a query with its
status), only (JSON, set by ``load``). Options are the request, as a provider would get it: max_results counts what they match. Pushed filters
come after it and change no other row. Pages that are not JSON end their query as response_parse_error."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual

from . import payloads as P

RECORDS = "provider string, query_id string, page int, pos int, place int, year int, type string, record string"
CALLS = "provider string, query_id string, pages int, returned_count int, status string, error string, http_status string, transient_error string, retry_after_seconds string"
# Records of a full page, and the most pages of a query.
PAGE_SIZE = {"openalex": 200, "semantic_scholar": 100, "arxiv": 100, "europe_pmc": 100}
PAGE_LIMIT = {"openalex": 50}
#: Queries that one task reads.
PER_TASK = 16
_ATOM, _ARXIV = "http://www.w3.org/2005/Atom", "http://arxiv.org/schemas/atom"


def _year(x) -> int | None:
    found = re.match(r"\s*(\d{4})", str(x or ""))
    return int(found[1]) if found else None


def _doi(x) -> str:
    """Key of a DOI within a query."""
    return re.sub(r"^(https?://(dx\.)?doi\.org/|doi:)", "", str(x or "").strip().lower()).rstrip(".,; ")


def _first(x) -> str:
    return str(x[0] if isinstance(x, list) and x else "" if isinstance(x, (list, dict)) or x is None else x)


def _json_records(provider: str, text: str):
    """(records, ends here) of a page; a record is (text or object, key, year, type)."""
    data = json.loads(text)
    if provider == "openalex":
        own = [(w, _doi(w.get("doi")), _year(w.get("publication_year")), w.get("type")) for w in data.get("results") or []]
        return own, not own
    if provider == "semantic_scholar":
        own = [(w, _doi((w.get("externalIds") or {}).get("DOI")), _year(w.get("year")), ";".join(w.get("publicationTypes") or [])) for w in data.get("data") or []]
        return own, len(own) < PAGE_SIZE[provider]
    own = []
    for w in (data.get("resultList") or {}).get("result") or []:
        key = _doi(w.get("doi")) or str(w.get("pmid") or (w.get("id") if w.get("source") == "MED" else "") or "") or str(w.get("title") or "")
        kinds = (w.get("pubTypeList") or {}).get("pubType") if isinstance(w.get("pubTypeList"), dict) else None
        own.append((w, key, _year(w.get("pubYear")) or _year(w.get("firstPublicationDate")), _first(kinds)))
    return own, not own or not data.get("nextCursorMark", "more")


def _atom_records(text: str):
    from xml.etree import ElementTree as E

    E.register_namespace("", _ATOM)
    E.register_namespace("arxiv", _ARXIV)
    root = E.fromstring(text)
    space = root.tag[: root.tag.index("}") + 1] if "}" in root.tag else ""
    own = []
    for e in root.findall(f"{space}entry"):
        name = (e.findtext(f"{space}id") or "").rpartition("/abs/")[2].strip()
        own.append((E.tostring(e, encoding="unicode"), name, _year(e.findtext(f"{space}published")), "preprint"))
    return own, len(own) < PAGE_SIZE["arxiv"]


class _Query(InputPartition):
    def __init__(self, queries: list[tuple[str, str, list[tuple[int, str]]]]):
        self.queries = queries


class PagesReader(DataSourceReader):
    def __init__(self, options, kind: str):
        self.options, self.kind, self.filters = {**options}, kind, []

    def pushFilters(self, filters) -> Iterator:
        """Takes the comparisons that state ``only``; yields the others back to Spark."""
        only = json.loads(self.options.get("only") or "{}")
        for f in filters:
            column = getattr(f, "attribute", ())
            want = only.get(column[0]) if len(column) == 1 else None
            if isinstance(want, list):
                own = isinstance(f, EqualTo) and want == [f.value] or isinstance(f, In) and {*f.value} == {*want} or isinstance(f, IsNotNull)
            elif want:
                own = isinstance(f, GreaterThanOrEqual) and f.value == want.get("from") or isinstance(f, LessThanOrEqual) and f.value == want.get("to") or isinstance(f, IsNotNull)
            if want and own:
                self.filters.append(f)
            else:
                yield f

    def _passes(self, row: dict, names) -> bool:
        for f in self.filters:
            name = f.attribute[0]
            if name not in names:
                continue
            x = row[name]
            ok = x is not None and (
                isinstance(f, IsNotNull) or isinstance(f, EqualTo) and x == f.value or isinstance(f, In) and x in f.value
                or isinstance(f, GreaterThanOrEqual) and x >= f.value or isinstance(f, LessThanOrEqual) and x <= f.value
            )
            if not ok:
                return False
        return True

    def _files(self):
        from pyarrow import fs

        path = self.options["path"].rstrip("/")
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))

    def partitions(self):
        from pyarrow import fs

        system, root = self._files()
        wanted = P.providers(self.options["providers"]) if self.options.get("providers") else list(P.READERS)
        found: dict[tuple[str, str], list[tuple[int, str]]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            m = re.search(r"/([^/]+)/([^/]+)/page-(\d+)(?:\.error)?\.(?:json|xml)$", info.path) or re.search(r"/provider=([^/]+)/query=([^/]+)/page=(\d+)/part-[^/]*$", info.path)
            if m and m[1] in wanted and self._passes({"provider": m[1], "query_id": unquote(m[2])}, ("provider", "query_id")):
                found.setdefault((m[1], unquote(m[2])), []).append((int(m[3]), info.path))
        queries = [(p, q, sorted(pages)) for (p, q), pages in sorted(found.items(), key=lambda x: (wanted.index(x[0][0]), x[0][1]))]
        return [_Query(queries[i : i + PER_TASK]) for i in range(0, len(queries), PER_TASK)] or [_Query([])]

    def read(self, partition: _Query):
        system, _ = self._files()
        for provider, query, pages in partition.queries:
            rows, call = self._query(system, provider, query, pages)
            if self.kind == "calls":
                yield call
            else:
                for r in rows:
                    if self._passes(r, ("page", "year", "type")):
                        yield tuple(r.values())

    def _query(self, system, provider: str, query: str, pages):
        """Rows of a query in order, and its call: at most max_results rows are held."""
        o = self.options
        most = int((o.get("semantic_max_results") if provider == "semantic_scholar" else None) or o.get("max_results") or 1 << 62)
        low, high = (int(o[k]) if o.get(k) else None for k in ("year_from", "year_to"))
        types = {t.strip() for t in re.split("[,|]", o.get("types") or "") if t.strip()}
        types = set() if types & {"*", "all", "none"} else types
        fields = [x.strip() for x in (o.get("fields") or "").split(",") if x.strip()]
        rows, seen, end, n_pages = [], set(), {}, 0
        for number, path in pages[: PAGE_LIMIT.get(provider, len(pages))]:
            if len(rows) >= most:
                break
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8-sig", "replace")
            try:
                if ".error." in path.rpartition("/")[2]:
                    end = json.loads(text)
                    break
                own, last = _atom_records(text) if provider == "arxiv" else _json_records(provider, text)
            except (ValueError, SyntaxError, AttributeError, TypeError) as e:
                end = {"status": "response_parse_error", "error": f"{type(e).__name__}: {e}", "transient": True}
                break
            n_pages += 1
            for pos, (record, key, year, kind) in enumerate(own):
                if len(rows) >= most:
                    break
                if provider == "openalex" and types and kind not in types or year is not None and (low is not None and year < low or high is not None and year > high):
                    continue
                if key and key in seen:
                    continue
                seen.add(key)
                if not isinstance(record, str):
                    record = json.dumps({k: v for k, v in record.items() if not fields or k in fields}, ensure_ascii=False)
                rows.append({"provider": provider, "query_id": query, "page": number, "pos": pos, "place": len(rows) + 1, "year": year, "type": kind, "record": record})
            if last:
                break
        status = str(end.get("status") or "error") if end else "ok" if rows else "empty_result"
        if end and rows and not status.startswith("partial"):
            status = f"partial_{status}"
        wait, transient = end.get("retry_after_seconds"), end.get("transient")
        return rows, (
            provider, query, n_pages, len(rows), status, str(end.get("error") or ""), str(end.get("http_status") or ""), "" if transient is None else str(bool(transient)).lower(), "" if wait is None else f"{float(wait):.3f}".rstrip("0").rstrip("."),
        )


class CapturedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return CALLS if self.options.get("what") == "calls" else RECORDS

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options, "calls" if self.options.get("what") == "calls" else "records")


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into it."""
    spark.dataSource.register(CapturedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, path: str, only: dict | None = None, **options) -> DataFrame:
    """Records (or calls) of a capture. only: by column a value, a list of values or a pair (from, to) with None for an open end;
    these filters are pushed into the reader, and rows without the value fail them."""
    register(spark)
    given = {k: ",".join(v) if isinstance(v, (list, tuple)) else str(v) for k, v in options.items() if v not in (None, "", [], ())}
    stated, conditions = {}, []
    for c, v in (only or {}).items():
        if isinstance(v, tuple):
            stated[c] = {"from": v[0], "to": v[1]}
            conditions += [F.col(c) >= v[0]] * (v[0] is not None) + [F.col(c) <= v[1]] * (v[1] is not None)
        else:
            stated[c] = [*v] if isinstance(v, list) else [v]
            conditions.append(F.col(c).isin(*stated[c]) if len(stated[c]) != 1 else F.col(c) == stated[c][0])
    df = spark.read.format("captured_pages").options(path=path, only=json.dumps(stated), **given).load()
    for c in conditions:
        df = df.where(c)
    return df


#: How a record becomes a page of its own again, for the readers of whole pages.
_WRAP = {"openalex": ('{"results":[', "]}"), "semantic_scholar": ('{"data":[', "]}"), "europe_pmc": ('{"resultList":{"result":[', "]}}"), "arxiv": ("<feed>", "</feed>")}


def search(spark: SparkSession, path: str, provider: str, only: dict | None = None, **request) -> DataFrame:
    """Candidate rows of one provider's queries (query_id, place, the provider's columns), as its searches would return them."""
    (provider,) = P.providers(provider)
    head, tail = _WRAP[provider]
    records = load(spark, path, only, providers=provider, **request)
    paged = records.select("query_id", F.col("place").alias("discovery_rank"), F.concat(F.lit(head), "record", F.lit(tail)).alias("payload"))
    return P.READERS[provider](paged).drop("pos")


def discovered(spark: SparkSession, path: str, providers: list[str], **request) -> DataFrame:
    """All providers' rows by name (missing columns empty), with discovery_provider."""
    from functools import reduce

    parts = [search(spark, path, p, **request).withColumn("discovery_provider", F.lit(p)) for p in providers]
    parts = [df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != "discovery_rank" else c for c in df.columns]) for df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).na.fill("")
