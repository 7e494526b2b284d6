"""One thin query per corpus operator, over whole tables, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, infill, jaccard, licences, mixing, neighbours, oracles, packing, pii, quality, secrets, suffixes, windows, wrappers
from .common import table


#: The join query's own shingles and threshold.
JOIN = jaccard.JaccardConfig(k=4, percent=85)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    more = [c for c in quality.ADDED if c not in (*first, "cleaned")]
    return out.select("doc_id", *first, *more, F.sha2("cleaned", 256).alias("cleaned_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect_pii(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", *[c for c in pii.ADDED if c != "found"])


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrappers.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", "n_chars")


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = mixing.MixConfig()
    out = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cfg, ["doc_id", "source"])
    cols = [F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(cfg.targets)]
    return out.select("doc_id", "source", "n_words", *cols, "rate")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", *[c for c in secrets.ADDED if c != "live"])


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def tokenizer_path() -> str:
    """The packing query's vocabulary: a public file outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), JOIN)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cfg = alignment.AlignConfig(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = {"groups_sha256": lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256))}
    return alignment.align(table(spark, sf_dir, "documents"), cfg, ["doc_id"], derive=digest)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.remove_windows(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_wrapper_induction": op4_wrapper_induction,
    "op5_soft_mixing": op5_soft_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_licence_digests": op7_licence_digests,
    "op8_anisotropic_neighbours": op8_anisotropic_neighbours,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_token_alignment": op11_token_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_window_dedup": op13_window_dedup,
}

ORACLE_SQL = {
    "op2_quality_rules": oracles.quality_sql(),
    "op6_secret_scan": oracles.secrets_sql(),
    "op7_licence_digests": oracles.licence_sql(),
    "op10_jaccard_join": oracles.jaccard_sql(JOIN.k, JOIN.percent),
    "op12_fill_in_middle": oracles.INFILL_SQL,
    "op13_window_dedup": oracles.windows_sql(50),
}
