"""One query per operator, over its whole table, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.llm import embed, fim, langid, licenses, packing, pii, simhash, spm, sql, substring, topk, toxicity, urls, whiten


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.shared_passages(_read(spark, sf_dir, "documents"), k=5, min_words=50, similarity=0.8)


#: Fixed values of the url contract.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op2_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES).drop("alias_verdict")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents")).drop("detections")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024.0)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(_read(spark, sf_dir, "documents"))
    return out.withColumn("base_sha256", F.sha2("base", 256)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"
    )


def public_vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = langid.vocabulary(public_vocabulary("piece_bpe_32k.model"))
    return langid.identify(_read(spark, sf_dir, "documents"), pieces)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"), window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids' number and crc32 (as for packing), and the decoded text's crc32."""
    vocab = spm.Vocabulary.load(public_vocabulary("piece_bpe_32k.model"))
    encoded = spm.encode(_read(spark, sf_dir, "documents"), vocab)
    return spm.decode(encoded, vocab, digest=True)


def op9_subspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(_read(spark, sf_dir, "documents"), radius=3, width=3, seed=42)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten_all(_read(spark, sf_dir, "embeddings"), components=32).withColumn("deviation", F.col("deviation").cast("long"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.7)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(_read(spark, sf_dir, "documents"))
    restored = fim.restore(F.col("output"), F.col("form"))
    digests = [F.sha2(c.cast("binary"), 256).alias(f"{name}_sha256") for name, c in (("output", F.col("output")), ("restored", restored))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the licence scan that SQL can say: words, and the places of the base phrases, -1 for none."""
    none = F.lit(-1).cast("long")
    bounds = [F.coalesce(c, none).alias(c) for c in ("first_word", "last_word")]
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", *bounds, "base_labels")


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the whitening that SQL can say: the fit list's size and exact deviations."""
    return op11_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the search for personal data that SQL can say: matches of the fixed patterns."""
    return pii.find_pii(_read(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_redirects": op2_redirects,
    "op3_licenses": op3_licenses,
    "op4_topk": op4_topk,
    "op5_pii": op5_pii,
    "op6_langid": op6_langid,
    "op7_packing": op7_packing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_subspaces": op9_subspaces,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_fill_in_middle": op13_fill_in_middle,
    "license_base": license_base,
    "pii_counts": pii_counts,
    "whitening_base": whitening_base,
}

SQL: dict[str, str] = {
    "op2_redirects": sql.OP2,
    "op4_topk": sql.OP4,
    "op9_subspaces": sql.OP9,
    "op13_fill_in_middle": sql.OP13,
    "license_base": sql.LICENSE_BASE,
    "pii_counts": sql.PII_COUNTS,
    "whitening_base": sql.WHITENING_BASE,
}
