"""The queries of this package over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import byte_bpe, collocations, exact_dedup, jaccard, license_scan, line_dedup, merkle, mixing, piece_bpe, quality, token_counts, topk, url_filter
from tocsin.llm.common import documents
from tocsin.sources.tables import read_table

TOKEN_LIMIT = 2048


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the packed wildcard automaton."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts from the keyed streaming state."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector, three-phase."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded in overlapping chunks, then decoded."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, sf_dir, "doc_id", "text")
    return byte_bpe.digests(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines whose template recurs in ten texts or more."""
    return line_dedup.drop_recurring_lines(documents(spark, sf_dir, "doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and notices of licenses in every text."""
    return license_scan.summary(license_scan.scan(documents(spark, sf_dir, "doc_id", "text")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by the kernel ridge classifier."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return quality.classify(documents(spark, sf_dir, "doc_id", "text"), labels)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by parity sketches."""
    return jaccard.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text: runs from the finite-state splitter, counted by memoised merges."""
    import public_tokenizers

    counts = token_counts.token_counts(documents(spark, sf_dir, "doc_id", "text"),
                                       public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped water-filling over the sources and seeded repetitions."""
    return (mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two and three words."""
    return collocations.mine(documents(spark, sf_dir, "text", "lang"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the agenda, checked and decoded."""
    import public_tokenizers

    docs = documents(spark, sf_dir, "doc_id", "text")
    return piece_bpe.digests(piece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf and proof, folded again after tampering."""
    return merkle.verified(merkle.proofs(documents(spark, sf_dir, *merkle.FIELDS)))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_exact_topk": op3_exact_topk,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_quality": op7_quality,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op1_url_filters": url_filter.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_exact_topk": topk.ORACLE,
    "op6_license_scan": license_scan.oracle(),
    "op10_mixing": mixing.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_merkle_manifest": merkle.oracle(),
}
