"""The registered queries: each operator on its whole table, with the settings meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm import alignment, bpe, brown, conv_quality, decontam, langid, licenses, minhash, pieces, quality_rules, ranked, substring
from shiftlens.llm.common import fold_is, table
from shiftlens.llm.urls import ALLOW, BLOCK, canonical, filter_urls, host_and_path

#: Fixed values: (verdict, host, path prefix).
URL_RULES = [(ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"),
             (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/")]
#: Site names whose pages make up the list of unwanted URLs.
UNWANTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; the listed URLs are the canonical ones of unwanted sites."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    listed = pages.filter(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, UNWANTED_SITES)))) \
        .select(canonical(host, path).alias("url"))
    return filter_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their fold, and those of them to learn from with their quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold_is("doc_id", 3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter("quality is not null")
    return docs, docs.filter("not held_out").join(labels, "doc_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the byte-level network, trained on two folds of three."""
    docs, known = _labelled(spark, sf_dir)
    return conv_quality.classify(docs, conv_quality.fit(known), keep=["doc_id", "held_out"])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether base rules and trees keep it; the trees learn from two folds of three."""
    docs, known = _labelled(spark, sf_dir)
    return quality_rules.apply_rules(docs, quality_rules.fit(known), keep=["doc_id"])


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.fit(docs), keep=["doc_id"])


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand inside a 10-word window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op7_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.tokenise(docs, tokenizer or tokenizer_path(), keep=["doc_id"]).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-bigram score of every document, learned from six folds of seven."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold_is("doc_id", 7, 2).alias("held_out"))
    model, words = brown.train(docs.filter("not held_out"), place_all=True)
    return brown.score(docs, model, words)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those of three folds of four."""
    docs = table(spark, sf_dir, "documents")
    held = fold_is("doc_id", 4, 2)
    model = langid.fit(docs.filter(~held))
    return langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside windows of 20 words that start earlier elsewhere."""
    return substring.dedup_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked.search_items(docs, table(spark, sf_dir, "benchmark"), k=10)


def op12_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Digests of every document's SentencePiece ids and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.tokenise(docs, model or tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"]).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every document's byte-level and SentencePiece tokens, weighed by their numbers in the corpus."""
    import public_tokenizers

    docs, second = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")
    aligned = alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), second, public_tokenizers.PATTERN, keep=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return alignment.score_links(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), second)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_quality_rules": op3_quality_rules,
        "op4_license_scan": op4_license_scan,
        "op5_minhash": op5_minhash,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_bpe": op7_bpe,
        "op8_brown_lm": op8_brown_lm,
        "op9_language_id": op9_language_id,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_ranked_search": op11_ranked_search,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_token_alignment": op13_token_alignment,
    }
