"""The thin queries over the operators, with the digest columns of their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, divergence, fingerprint, interaction, linededup, mixing, packing, quality, secrets, simhash, suffix, toxicity, urls
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint of three-word shingles and the least doc_id reachable over links of two bits."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    hex16 = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return found.select("doc_id", hex16.alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base spans, their digest, and all spans with those of dear credential values."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the score of the chain fitted on labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its sketch, that of its edited text, and how alike they and the next document's are."""
    f = fingerprint.compare(table(spark, sf_dir, "documents"))
    return f.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.printed(F.col("sketch")).alias("fingerprint"),
        fingerprint.printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, rule, verdict, and the template with the purity, and its bound, that the verdict rests on."""
    judged = urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity", "purity_at_most")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its statistics, the base verdict and the method's."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text, and how many lines it had and lost."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with how many bytes and stretches repeat elsewhere, and the digest of the rest."""
    return suffix.dedup_strings(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text, by the labeller fitted on a bounded sample of the pages."""
    pages = table(spark, sf_dir, "pages")
    return blocks.extract(pages, blocks.train(pages))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language with how far they lie apart, and each source's ten most lifted terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language, order of the five filters and step with what is kept, removed and redundant there."""
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_source_mixing": op4_source_mixing,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_url_filters": op7_url_filters,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_html_extraction": op11_html_extraction,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_interaction": op13_filter_interaction,
}
ORACLE_SQL = {
    "op4_source_mixing": mixing.SQL,
    "op9_line_dedup": linededup.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_filter_interaction": interaction.SQL,
}
