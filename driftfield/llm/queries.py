"""Registered queries of this subpackage and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftfield.llm import divergence, forest, language, licences, metric, mixing, neardup, pieces, quality, secrets, spelling, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register("op1_mix_sources", mixing.SQL)
def op1_mix_sources(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_register("op2_quality_ledger", quality.SQL)
def op2_quality_ledger(spark, sf_dir):
    return quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents"))).drop("policy")


@_register("quality_ablations", quality.ABLATIONS_SQL)
def quality_ablations(spark, sf_dir):
    return quality.ablations(quality.ledger(_table(spark, sf_dir, "documents")))


@_register("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


@_register("op4_warc", warc.SQL)
def op4_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_register("op5_language")
def op5_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def piece_model() -> bytes:
    """The public 32,000-piece model; its path is the parameter of ``pieces.tokenize``."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@_register("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    return pieces.token_digests(pieces.tokenize(_table(spark, sf_dir, "documents"), piece_model(), packed=True))


@_register("op7_licence_scan", licences.SQL)
def op7_licence_scan(spark, sf_dir):
    return licences.scan(_table(spark, sf_dir, "documents"))


@_register("op8_near_duplicates")
def op8_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=2)


@_register("op9_url_filter", urls.SQL)
def op9_url_filter(spark, sf_dir):
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


@_register("op10_nearest_vectors")
def op10_nearest_vectors(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@_register("op11_spelling_variants", spelling.SQL)
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(_table(spark, sf_dir, "documents"))


@_register("op12_jaccard_join")
def op12_jaccard_join(spark, sf_dir):
    return metric.similar_documents(_table(spark, sf_dir, "documents"), k=5)


@_register("op13_source_divergence", divergence.SQL)
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))
