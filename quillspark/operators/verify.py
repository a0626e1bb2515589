"""Verification against an authority table: keyed join, mismatch rules, title match, reuse and cache."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts, which no built-in computes; Arrow batches.

    Every row reaches Python whatever a CASE around this says; rows with a null are passed over there."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return pandas_udf(run, "double")(a, b)


def title_text(c) -> Column:
    """Title as it is compared: no tags, lower case, no full stops at the end, white space collapsed."""
    x = F.regexp_replace(F.lower(T.strip(F.regexp_replace(T.text(c), "<[^>]+>", ""))), r"\.+$", "")
    return F.regexp_replace(x, r"(?U)\s+", " ")


def similarity(a, b) -> Column:
    """0 if one is blank, 1 if equal, else the ratio; for all other rows its inputs are null."""
    x, y = title_text(a), title_text(b)
    asked = (x != "") & (y != "") & (x != y)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(ratio(F.when(asked, x), F.when(asked, y)))


#: Columns that verification fills, in their order: metadata of the authority, then what the lookup found.
META = ("crossref_doi", "crossref_title", "crossref_container", "crossref_publisher", "crossref_type", "crossref_year", "crossref_issn", "crossref_url", "crossref_created", "crossref_published")
FOUND = ("crossref_mismatches", "crossref_lookup_method", "crossref_title_similarity", "crossref_recovered_doi_confidence", "crossref_status", "crossref_verified", "crossref_retry_after_seconds", "crossref_cache_status", "crossref_cache_key")
#: Column of an authority table for each of META; those that it lacks are blank.
_OF = dict(zip(META, ("doi", "title", "journal", "publisher", "type", "year", "issn", "url", "created", "published")))
#: Statuses of an earlier output that are final.
TERMINAL = ("verified", "title_recovered", "mismatch", "missing_doi")
CACHE = "key string, status string, value string, created_at timestamp, updated_at timestamp, expires_at timestamp"
_SPREAD = 1024


def below(a: Column, b: Column, least: float) -> Column:
    """similarity(a, b) < least for filled texts that differ; most pairs are decided without Python.

    Matching characters are at most the shorter length, and half of what the edit distance leaves of both lengths."""
    n, m = F.length(a), F.length(b)
    sure = (2 * F.least(n, m) < (n + m) * (least - 1e-9)) | (F.levenshtein(a, b) > (n + m) * (1 - least + 1e-9))
    return F.when(sure, True).otherwise(ratio(F.when(~sure, a), F.when(~sure, b)) < least)


def fixed(x: Column, places: int) -> Column:
    """A number from 0 to 1 with so many decimals, its binary value rounded exactly and ties to even; format_string rounds its shortest decimal text up."""
    whole = F.lit(1 << 60).cast("decimal(20,0)")
    scaled = (x * float(1 << 60)).cast("long").cast("decimal(20,0)") * F.lit(10**places).cast("decimal(4,0)")
    q = F.call_function("div", scaled, whole)
    twice = (scaled - q.cast("decimal(20,0)") * whole) * F.lit(2).cast("decimal(1,0)")
    k = q + F.when((twice > whole) | ((twice == whole) & (q % 2 == 1)), 1).otherwise(0)
    return F.concat(F.call_function("div", k, F.lit(10**places)).cast("string"), F.lit("."), F.lpad((k % 10**places).cast("string"), places, "0"))


def _own(df: DataFrame, *names) -> Column:
    have = [n for n in names if n in df.columns]
    return T.strip(T.first_filled(*have)) if have else F.lit("")


def identities(df: DataFrame) -> tuple[Column, Column]:
    """(identity, identity by title) of rows: the DOI, else title, year and journal."""
    squeezed = lambda *names: F.lower(T.squeeze(_own(df, *names)))
    by_title = F.concat(F.lit("title:"), squeezed("crossref_title", "title"), F.lit("|year:"), _own(df, "crossref_year", "publication_year", "year"), F.lit("|journal:"), squeezed("crossref_container", "journal"))
    doi = T.doi(_own(df, "crossref_doi", "doi"))
    return F.when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(by_title), by_title


def prior_rows(prior: DataFrame, statuses=TERMINAL) -> DataFrame:
    """(_id, _p): final rows of an earlier output under both their identities, the last row of an identity first: one aggregation.

    So a row whose DOI was filled by the earlier run is found by its title when it comes without one."""
    kept = [c for c in ("doi", *META, *FOUND) if c in prior.columns]
    own, by_title = identities(prior)
    rows = prior.where(T.strip("crossref_status").isin(*statuses))
    keyed = rows.select("_ord", F.struct(*kept).alias("_p"), F.posexplode(F.array(own, by_title)).alias("_which", "_id"))
    return keyed.groupBy("_id").agg(F.max_by("_p", F.struct("_ord", "_which")).alias("_p"))


def cache_key(kind: str, *parts) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.sha2(F.to_json(F.struct(F.array(*parts).alias("parts"))), 256))


def _authority(authority: DataFrame) -> tuple[DataFrame, list[str]]:
    """(_k, a): metadata by normalised DOI, the first row of a DOI by _ord (else by content)."""
    cells = F.struct(*[(T.doi("doi") if k == "crossref_doi" else T.text(F.col(c).cast("string")) if c in authority.columns else F.lit("")).alias(k) for k, c in _OF.items()])
    order = F.struct(*[F.col(c) for c in ("_ord", *_OF.values()) if c in authority.columns])
    return authority.select(T.doi("doi").alias("_k"), cells.alias("a"), order.alias("o")).where("_k <> ''").groupBy("_k").agg(F.min_by("a", "o").alias("a"))


def mismatches(df: DataFrame, meta: str, strict: bool) -> DataFrame:
    """Adds _found: texts of the differences between a row and its metadata struct, joined. Columns _t, _y, _j hold the row's own values."""
    t, y, j = F.col("_t"), F.col("_y"), F.lower("_j")
    xt, xy, xj = F.col(f"{meta}.crossref_title"), F.col(f"{meta}.crossref_year"), F.lower(f"{meta}.crossref_container")
    x, z, p, q = title_text(t), title_text(xt), title_text(j), title_text(xj)
    titled, named = (t != "") & (xt != ""), (j != "") & (xj != "") & (j != xj)
    score, far = F.col("_score"), F.col("_far")
    sim = fixed(score, 2)
    quoted = lambda label, a, b, n, end: F.concat(F.lit(f"{label}: input='"), F.substring(a, 1, n), F.lit("' vs crossref='"), F.substring(b, 1, n), F.lit("'"), end)
    found = [
        (titled & (score < 0.85), quoted("TITLE_MISMATCH", t, xt, 80, F.concat(F.lit(" (sim="), sim, F.lit(")")))),
        (titled & (score >= 0.85) & (score < 0.95) & F.lit(strict), F.concat(F.lit("TITLE_MINOR_DIFF: input vs crossref (sim="), sim, F.lit(")"))),
        ((y != "") & (xy != "") & (y != xy), F.concat(F.lit("YEAR_MISMATCH: input="), y, F.lit(" vs crossref="), xy)),
        (named & far, quoted("JOURNAL_MISMATCH", j, xj, 60, F.lit(""))),
    ]
    # both similarities are columns of their own, so one Python pass serves them; pairs that need none go as nulls
    asked = titled & (x != "") & (z != "") & (x != z)
    names = named & (p != "") & (q != "") & (p != q)
    df = df.withColumns({
        "_score": F.when(asked, ratio(F.when(asked, x), F.when(asked, z))).when(titled & (x == z) & (x != ""), 1.0).otherwise(0.0),
        "_far": F.when(names, below(F.when(names, p), F.when(names, q), 0.8)).otherwise((p == "") | (q == "")),
    })
    return df.withColumn("_found", F.array_join(T.compact(found), "; "))


def verify(df: DataFrame, authority: DataFrame, strict=False, title_lookup=False, prior: DataFrame | None = None, cache: DataFrame | None = None, now: Column | None = None, ttl_seconds: float | None = None, max_rows: int | None = None, failures: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Every row with the columns META and FOUND; ``doi`` is filled where a title recovers it.

    Order of decisions: final rows of ``prior`` are used again (missing DOIs only without title_lookup); rows from _ord ``max_rows`` on are
    over the budget; a row with a DOI gets the metadata of an unexpired ``cache`` row, else a failure of ``failures`` (doi or title,
    status, retry_after_seconds), else of ``authority``, and is verified, a mismatch or lookup_failed; a row without one is missing_doi or,
    with title_lookup, gets its best title match, the same way. Rows found outside the cache are marked ``store`` (see ``cache_rows``).
    authority: doi and any of title, journal, publisher, type, year, issn, url, created, published; with title_lookup also a unique _ord.
    df needs _ord for title_lookup and max_rows. Joins are by single keys; rows without a DOI are spread over _SPREAD keys that match nothing."""
    now = F.current_timestamp() if now is None else now
    given = [c for c in df.columns if c not in META + FOUND]
    rows = df.withColumn("doi", T.text("doi") if "doi" in df.columns else F.lit(""))
    raw, normal = T.strip("doi"), T.doi("doi")
    rows = rows.withColumns({"_raw": raw, "_n": normal, "_t": _own(df, "title"), "_y": _own(df, "publication_year"), "_j": _own(df, "journal")})
    if prior is not None:
        rows = rows.withColumn("_id", identities(df)[0]).join(prior_rows(prior), "_id", "left").drop("_id")
        again = F.col("_p").isNotNull() & ~(F.lit(title_lookup) & (F.col("_p.crossref_status") == "missing_doi"))
    else:
        again = F.lit(False)
    over = (F.col("_ord") >= max_rows) if max_rows is not None and max_rows >= 0 else F.lit(False)
    no_doi = F.col("_raw") == ""
    rows = rows.withColumns({"_again": again, "_over": over})
    rows = rows.withColumn("_todo", ~F.col("_again") & ~F.col("_over"))
    asks = F.col("_todo") & (~no_doi | F.lit(title_lookup))
    journal = F.when(F.col("_j") != "", F.col("_j")).otherwise(_own(df, "container"))
    key = F.when(~no_doi, cache_key("doi", F.col("_n"))).otherwise(cache_key("title", F.col("_t"), _own(df, "publication_year", "year"), journal))
    rows = rows.withColumns({"_asks": asks, "_key": F.when(asks, key).otherwise("")})
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("_t", "_y"), F.lit(_SPREAD)).cast("string"))
    if cache is not None:
        live = live_cache(cache, now, ttl_seconds).select(F.col("key").alias("_ck"), F.from_json("value", f"STRUCT<{', '.join(f'{c}: STRING' for c in (*META, 'crossref_title_similarity', 'crossref_recovered_doi_confidence'))}>").alias("_c"))
        rows = rows.withColumn("_jk", F.when(F.col("_key") != "", F.col("_key")).otherwise(spread)).join(live, F.col("_jk") == F.col("_ck"), "left").drop("_jk")
    else:
        rows = rows.withColumns({"_ck": F.lit(None).cast("string"), "_c": F.lit(None).cast("struct<crossref_doi:string>")})
    rows = rows.withColumn("_hit", F.col("_ck").isNotNull())
    if failures is not None:
        mark = lambda doi, title: F.when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("title:"), title))
        own = failures.select(mark(T.doi("doi") if "doi" in failures.columns else F.lit(""), _own(failures, "title")).alias("_fk"), F.struct("status", (T.text(F.col("retry_after_seconds").cast("string")) if "retry_after_seconds" in failures.columns else F.lit("")).alias("wait")).alias("_f")).groupBy("_fk").agg(F.min("_f").alias("_f"))
        rows = rows.join(own, mark(F.col("_n"), F.col("_t")) == F.col("_fk"), "left").drop("_fk").withColumn("_f", F.when(F.col("_asks") & ~F.col("_hit"), F.col("_f")))
    else:
        rows = rows.withColumn("_f", F.lit(None).cast("struct<status:string,wait:string>"))
    looked = F.col("_asks") & ~F.col("_hit") & F.col("_f").isNull()
    rows = rows.withColumn("_dk", F.when(looked & (F.col("_n") != ""), F.col("_n")).otherwise(spread))
    rows = rows.join(_authority(authority), F.col("_dk") == F.col("_k"), "left").drop("_dk", "_k")
    scored = ("crossref_title_similarity", "crossref_recovered_doi_confidence")
    if title_lookup:
        todo = rows.where(looked & no_doi).select("_ord", F.col("_t").alias("title"), _own(df, "publication_year", "year").alias("publication_year"), journal.alias("journal"))
        best = best_title(todo, authority, index=index).where("a_ord is not null").select(F.col("_ord").alias("_bo"), "a_ord", "similarity", "match_confidence")
        cells = authority.select(F.col("_ord").alias("a_ord"), *[(T.doi("doi") if k == "crossref_doi" else T.text(F.col(c).cast("string")) if c in authority.columns else F.lit("")).alias(k) for k, c in _OF.items()])
        b = best.join(cells, "a_ord").select("_bo", F.struct(*META, fixed(F.col("similarity"), 3).alias(scored[0]), F.col("match_confidence").alias(scored[1])).alias("_b"))
        rows = rows.join(b, F.col("_ord") == F.col("_bo"), "left").drop("_bo")
    else:
        rows = rows.withColumn("_b", F.lit(None).cast(f"struct<{','.join(f'{c}:string' for c in (*META, *scored))}>"))
    pick = lambda c: F.coalesce(F.col(f"_c.{c}") if cache is not None else F.lit(None).cast("string"), F.col(f"a.{c}") if c in META else F.lit(None).cast("string"), F.col(f"_b.{c}"))
    rows = rows.withColumn("_m", F.when(F.col("_hit") | F.col("a").isNotNull() | F.col("_b").isNotNull(), F.struct(*[T.text(pick(c)).alias(c) for c in (*META, *scored)]))).drop("a", "_b", "_c")
    rows = mismatches(rows, "_m", strict)
    known, failed = F.col("_m").isNotNull(), F.col("_f").isNotNull()
    diff = F.col("_found")
    status = (
        F.when(F.col("_over"), "skipped_budget").when(failed, F.col("_f.status")).when(no_doi & F.lit(not title_lookup), "missing_doi")
        .when(no_doi, F.when(known, "title_recovered").otherwise("title_lookup_failed")).when(~known, "lookup_failed").when(diff != "", "mismatch").otherwise("verified")
    )
    text = (
        F.when(F.col("_over"), "SKIPPED_BY_MAX_ROWS_BUDGET").when(failed, F.concat(F.lit("CROSSREF_"), F.upper("_f.status"))).when(no_doi & F.lit(not title_lookup), "NO_DOI")
        .when(no_doi, F.when(known, "").otherwise("NO_DOI_TITLE_LOOKUP_FAILED")).when(~known, "CROSSREF_LOOKUP_FAILED").otherwise(diff)
    )
    rows = rows.withColumns({"_status": status, "_text": text})
    state = F.when(F.col("_asks"), F.when(F.col("_hit"), "hit").when(F.lit(cache is None), "disabled").when(known, "store").otherwise("miss")).otherwise(_own(df, "crossref_cache_status"))
    new = {
        "crossref_mismatches": F.col("_text"), "crossref_status": F.col("_status"), "crossref_verified": F.col("_status").isin("verified", "title_recovered").cast("string"),
        "crossref_lookup_method": F.when(known, F.when(no_doi, "title_search").otherwise("doi")).otherwise(_own(df, "crossref_lookup_method")),
        "crossref_retry_after_seconds": F.when(failed, F.col("_f.wait")).otherwise(_own(df, "crossref_retry_after_seconds")),
        "crossref_cache_status": state, "crossref_cache_key": F.when(F.col("_asks"), F.col("_key") if cache is not None else F.lit("")).otherwise(_own(df, "crossref_cache_key")),
        **{c: F.when(known & no_doi, F.col(f"_m.{c}")).otherwise(_own(df, c)) for c in scored},
        **{c: F.when(known, F.col(f"_m.{c}")).otherwise(T.text(c) if c in df.columns else F.lit("")) for c in META},
    }
    cells = {c: new[c] for c in META + FOUND}
    cells["doi"] = F.when(known & no_doi, F.col("_m.crossref_doi")).otherwise(F.col("doi"))
    if prior is not None:
        old = set(rows.schema["_p"].dataType.names)
        own = lambda c: T.text(c) if c in rows.columns else F.lit("")
        cells = {c: F.when(F.col("_again"), T.first_filled(f"_p.{c}", own(c)) if c in old else own(c)).otherwise(x) for c, x in cells.items()}
        cells["_reused"] = F.col("_again")
    else:
        cells["_reused"] = F.lit(False)
    out = [cells["doi"].alias("doi") if c == "doi" else F.col(c) for c in given] + ([] if "doi" in given else [cells["doi"].alias("doi")])
    return rows.select(*out, *[cells[c].alias(c) for c in META + FOUND], cells["_reused"].alias("crossref_reused"))


def verification_counts() -> dict[str, Column]:
    """Aggregates over a verified table: rows by status, by use of the cache, and used again."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    statuses = ("verified", "title_recovered", "mismatch", "lookup_failed", "missing_doi", "title_lookup_failed", "rate_limited", "network_error", "auth_error", "response_parse_error", "provider_error", "skipped_budget")
    fresh = ~F.col("crossref_reused")
    return {s: n("crossref_status", s) for s in statuses} | {
        "cache_hit": F.count_if(fresh & (F.col("crossref_cache_status") == "hit")), "cache_miss": F.count_if(fresh & F.col("crossref_cache_status").isin("miss", "store")),
        "cache_store": F.count_if(fresh & (F.col("crossref_cache_status") == "store")), "reused": F.count_if("crossref_reused"),
    }


def cache_rows(verified: DataFrame, now: Column, ttl_seconds: float | None = None) -> DataFrame:
    """Records to ``upsert`` for the rows that were found outside the cache."""
    until = F.lit(None).cast("timestamp") if ttl_seconds is None else now + F.make_dt_interval(secs=F.lit(max(0.0, float(ttl_seconds))))
    value = F.to_json(F.struct(*META, "crossref_title_similarity", "crossref_recovered_doi_confidence"))
    fresh = verified.where("crossref_cache_status = 'store' and not crossref_reused")
    status = F.when(F.col("crossref_lookup_method") == "title_search", "title_recovered").otherwise("verified")
    one = fresh.groupBy(F.col("crossref_cache_key").alias("key")).agg(F.min(F.struct(status.alias("status"), value.alias("value"))).alias("r"))
    return one.select("key", "r.*", now.alias("created_at"), now.alias("updated_at"), until.alias("expires_at"))


def authority_join(df: DataFrame, authority: DataFrame, strict=False) -> DataFrame:
    """``verify`` by DOI alone."""
    return verify(df, authority, strict).drop("crossref_reused")


def keep_last(df: DataFrame, *keys) -> DataFrame:
    """The row of the largest _ord of each key: an aggregate with map-side combine."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "_ord").alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, key: str, blank_kept=True) -> DataFrame:
    """First row of each key by _ord, as an aggregate; blank keys are never deduplicated and take no part in it."""
    filled = T.text(key) != ""
    best = df.where(filled).groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), "_ord").alias("r"))
    keyed = best.select(*[F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])
    return keyed.unionByName(df.where(~filled)) if blank_kept else keyed


def reuse(df: DataFrame, prior: DataFrame, key: str, columns, statuses, status="crossref_status") -> tuple[DataFrame, DataFrame]:
    """(rows completed from an earlier output in a terminal status, rows still to do)."""
    done = keep_last(prior.where(F.col(status).isin(*statuses) & (T.text(key) != "")), key).select(key, *[F.col(c).alias(f"_p_{c}") for c in columns], F.lit(True).alias("_p"))
    out = df.join(done, key, "left")
    hit = out.where("_p").select(*[(T.first_filled(f"_p_{c}", c) if c in columns else F.col(c)).alias(c) for c in df.columns], *[T.text(f"_p_{c}").alias(c) for c in columns if c not in df.columns])
    return hit, out.where("_p is null").select(*df.columns)


def live_cache(cache: DataFrame, now: Column, ttl_seconds: float | None, statuses=()) -> DataFrame:
    """(key, value) of the cache's unexpired rows, the newest of a key. Rows without expires_at live ttl_seconds from updated_at, or for ever."""
    until = F.col("expires_at") if ttl_seconds is None else F.coalesce("expires_at", F.col("updated_at") + F.make_dt_interval(secs=F.lit(float(ttl_seconds))))
    live = cache.where(until.isNull() | (until > now) if ttl_seconds is None else until > now)
    live = live.where(F.col("status").isin(*statuses)) if statuses else live
    return live.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"))


def ttl_lookup(df: DataFrame, cache: DataFrame, key: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Adds ``value`` from unexpired cache rows (key, status, value, updated_at, expires_at)."""
    live = live_cache(cache, now, ttl_seconds, ("ok",))
    return df.join(live, F.col(key) == F.col("key"), "left").drop("key") if key != "key" else df.join(live, "key", "left")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Newest record per key; created_at stays the oldest."""
    both = cache.unionByName(new)
    return both.groupBy("key").agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max_by(F.struct("status", "value", "expires_at"), "updated_at").alias("r")).select("key", "created_at", "updated_at", "r.*")


def _pieces(length: Column, least: float) -> Column:
    """Length of the pieces of an authority title of which at least one stands unbroken in every title of ratio >= least.

    A ratio of least means at most (1 - least) * (sum of the lengths) unmatched characters, each of which breaks one piece
    at most, and a length of (2 / least - 1) times the other at most."""
    longest = F.floor(length * (2 / least - 1) + 1e-9)
    return F.floor(length / (F.floor((length + longest) * (1 - least) + 1e-9) + 1)).cast("int")


def title_index(authority: DataFrame, folder: str, least=0.90) -> DataFrame:
    """Inverted index (hash of a piece, its place and title) of an authority's titles, written once and used by later runs.

    The folder's name holds the fingerprint of the titles, so another table gets another index. Files are
    dealt by hash and sorted by it, so a lookup's join need not sort them again."""
    from ..plans.pipeline import fingerprint
    from ..sources import storage

    spark, own = authority.sparkSession, authority.select("_ord", "title")
    path = f"{folder.rstrip('/')}/titles-{fingerprint(own)[:16]}-{least}"
    if not storage.exists(spark, f"{path}/_SUCCESS"):
        rows = own.select(F.col("_ord").alias("a_ord"), title_text("title").alias("_y")).withColumn("_m", F.length("_y")).where("_m > 0")
        _piece_rows(rows.withColumn("_q", _pieces(F.col("_m"), least))).repartition("_g").sortWithinPartitions("_g").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _piece_rows(right: DataFrame) -> DataFrame:
    """(a_ord, _m, _q, _j, _g): the pieces of each title, _q characters from every _q-th place on."""
    q = F.col("_q")
    b = right.withColumn("_j", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_m") - q + 1, F.lit(1)), F.greatest(q, F.lit(1)))))
    return b.select("a_ord", "_m", "_q", "_j", F.xxhash64("_q", F.col("_y").substr(F.col("_j"), q)).alias("_g"))


def title_candidates(left: DataFrame, right: DataFrame, least: float, index: DataFrame | None = None) -> DataFrame:
    """All pairs (left with text _x, right with text _y) that can reach the ratio; no pair that reaches it is missed.

    index: the pieces of all of right for the same ``least`` (``title_index``), else they are made. Pieces of _y are looked up among the substrings of _x of their length; lengths, the shift of the piece and the edit
    distance then bound the ratio. Only numbers meet in the lookup, and only texts that have a counterpart of fitting length."""
    over, least_by = 2 / least - 1, lambda n, m: (n + m) * (least / 2) - 1e-9
    left, right = left.withColumn("_n", F.length("_x")).where("_n > 0"), right.withColumn("_m", F.length("_y")).where("_m > 0")
    n, m, q = F.col("_n"), F.col("_m"), F.col("_q")
    # lengths that occur on both sides and can reach the ratio, with the length of the pieces
    spans = right.select("_m").distinct().withColumn("_q", _pieces(m, least)).withColumn("_n", F.explode(F.sequence(F.ceil(m / over - 1e-9).cast("int"), F.floor(m * over + 1e-9).cast("int"))))
    spans = spans.join(left.select("_n").distinct(), "_n")
    last = lambda size: F.greatest(size - q + 1, F.lit(1))
    a = left.select("_ord", "_n", "_x").join(F.broadcast(spans.select("_n", "_q").distinct()), "_n").withColumn("_i", F.explode(F.sequence(F.lit(1), last(n))))
    a = a.select("_ord", "_n", "_i", F.xxhash64("_q", F.col("_x").substr(F.col("_i"), q)).alias("_g"))
    here = F.broadcast(spans.select("_m", "_q").distinct())
    b = _piece_rows(right.join(here, "_m")) if index is None else index.join(here, ["_m", "_q"], "left_semi")
    half, shift = least_by(n, m), F.col("_i") - F.col("_j")
    near = (n >= half) & (m >= half) & ((q == 0) | ((shift <= n - half) & (-shift <= m - half)))
    pair = a.join(b, "_g").where(near).select("_ord", "a_ord").distinct().join(left, "_ord").join(right, "a_ord")
    bound = F.floor((n + m) * (1 - least) + 1e-9).cast("int")
    return pair.withColumn("_k", bound).where(F.expr("levenshtein(_x, _y, _k) >= 0")).drop("_k", "_n", "_m")


def _title_pairs(df: DataFrame, authority: DataFrame, least: float, without_context: float, journals: float, index: DataFrame | None) -> DataFrame:
    """Pairs (_ord, a_ord, a_title, similarity, context) that pass all conditions of ``best_title``."""
    blank = F.lit("")
    own = {c: T.strip(c) if c in df.columns else blank for c in ("publication_year", "journal")}
    left = df.where(F.length(T.strip("title")) >= 5).select("_ord", title_text("title").alias("_x"), own["publication_year"].alias("_year"), own["journal"].alias("_journal"))
    theirs = {c: T.strip(c) if c in authority.columns else blank for c in ("year", "journal")}
    right = authority.select(F.col("_ord").alias("a_ord"), F.col("title").alias("a_title"), title_text("title").alias("_y"), theirs["year"].alias("a_year"), theirs["journal"].alias("a_journal"))
    pair = title_candidates(left, right, min(least, without_context), index)
    pair = pair.where((F.col("_year") == "") | (F.col("a_year") == "") | (F.col("_year") == F.col("a_year")))
    x, y = F.col("_x"), F.col("_y")
    pair = pair.withColumn("similarity", F.when(x == y, 1.0).otherwise(ratio(F.when(x != y, x), F.when(x != y, y))))
    pair = pair.withColumn("context", (F.col("_year") != "") | (F.col("_journal") != ""))
    pair = pair.where(F.col("similarity") >= F.when(F.col("context"), least).otherwise(without_context))
    p, q = title_text("_journal"), title_text("a_journal")
    asked = (p != "") & (q != "") & (p != q)
    near = F.when(asked, ~below(F.when(asked, p), F.when(asked, q), journals)).otherwise((p == q) & (p != ""))
    return pair.where((F.col("_journal") == "") | (F.col("a_journal") == "") | near)


def title_search(df: DataFrame, authority: DataFrame, k: int = 5, least=0.90, without_context=0.95, journals=0.80, index: DataFrame | None = None) -> DataFrame:
    """(_ord, place, a_ord, a_title, similarity): the k best authority rows of each title, the most similar first, then by a_ord.

    Spark limits each title to k rows before the shuffle."""
    from pyspark.sql import Window as W

    pairs = _title_pairs(df, authority, least, without_context, journals, index)
    place = F.row_number().over(W.partitionBy("_ord").orderBy(F.desc("similarity"), "a_ord"))
    return pairs.select("_ord", place.alias("place"), "a_ord", "a_title", "similarity").where(F.col("place") <= k)


def best_title(df: DataFrame, authority: DataFrame, least=0.90, without_context=0.95, journals=0.80, index: DataFrame | None = None) -> DataFrame:
    """Best authority row per title of five characters or more, as the similarity decides.

    A row with a year or a journal has context: it needs ``least``, others ``without_context``. Years that are both filled must
    be equal, journals that are both filled similar; the first authority row wins a tie. Year and journal columns are optional on
    both sides. index: see ``title_index``, made for min(least, without_context)."""
    pair = _title_pairs(df, authority, least, without_context, journals, index)
    sure = F.when((F.col("similarity") >= 0.97) & F.col("context"), "high").otherwise("medium").alias("match_confidence")
    best = pair.groupBy("_ord").agg(F.min_by(F.struct("a_ord", "a_title", "similarity", sure), F.struct(-F.col("similarity"), F.col("a_ord"))).alias("m"))
    return df.join(best.select("_ord", "m.*"), "_ord", "left")
