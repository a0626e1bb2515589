"""Queries op1 to op13 and their DuckDB SQL. Each reads its whole table and calls its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import capfilter, chat, decontam, divergence, elkan, language, licenses, neardup, packing, pieces, quality, toxicity, urlfilter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(out: DataFrame, folds: int, fold: int, first: list[str]) -> DataFrame:
    """doc_id, held_out and the columns of ``first``, then the others."""
    mark = F.expr(f"coalesce(crc32(cast(doc_id as string)) % {folds} = {fold}, false)").alias("held_out")
    return out.select("doc_id", mark, *first, *[c for c in out.columns if c not in ("doc_id", *first)])


def op1_quality(spark, sf_dir):
    return quality.judge(_read(spark, sf_dir, "documents"), quality.trusted_ids(_read(spark, sf_dir, "labels")))


def op3_licenses(spark, sf_dir):
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op4_language(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    out = language.identify(docs, language.training_fold(docs))
    return _held_out(out, 4, 2, ["lang_pred", "score"])


def op5_toxicity(spark, sf_dir):
    out = toxicity.score(_read(spark, sf_dir, "documents"), toxicity.training_fold(_read(spark, sf_dir, "labels")))
    return _held_out(out, 5, 0, ["score", "predicted"])


def op6_chat(spark, sf_dir):
    return chat.collapse(_read(spark, sf_dir, "conversations"))


def op7_urls(spark, sf_dir, blocklist: DataFrame | None = None):
    """``blocklist``: column key, for instance from urlfilter.read_list; else the hosts with a label of an ad server."""
    pages = _read(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.listed_hosts(pages) if blocklist is None else blocklist)


def op2_neardup(spark, sf_dir):
    return neardup.group(_read(spark, sf_dir, "documents"))


def op8_embeddings(spark, sf_dir):
    return capfilter.link(_read(spark, sf_dir, "embeddings"))


def op9_pieces(spark, sf_dir):
    return pieces.sample(_read(spark, sf_dir, "documents"), digest=True)


def op10_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"))


def op11_centroids(spark, sf_dir):
    return elkan.cluster(_read(spark, sf_dir, "embeddings"))


def op12_divergence(spark, sf_dir):
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_decontamination(spark, sf_dir):
    return decontam.digest(decontam.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


QUERIES = {f.__name__: f for f in (op1_quality, op2_neardup, op3_licenses, op4_language, op5_toxicity, op6_chat, op7_urls, op8_embeddings, op9_pieces, op10_packing, op11_centroids, op12_divergence, op13_decontamination)}
ORACLES = {"op3_licenses": licenses.oracle(), "op6_chat": chat.ORACLE, "op7_urls": urlfilter.oracle(), "op11_centroids": elkan.oracle(), "op12_divergence": divergence.ORACLE, "op13_decontamination": decontam.ORACLE}
