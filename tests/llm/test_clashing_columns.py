"""Extra columns whose names clash with inner or added ones change nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import jaccard, licences, mixing, neighbours, packing, pii, quality, queries, secrets, suffixes, wrappers

CLASH = ["text_id", "n", "set_id", "row_id", "part", "length", "rank", "piece", "copies", "b", "s", "q", "v", "vec", "kept", "spans", "found", "live", "rate", "licence", "_row", "_words", "_text", "_cand", "_found", "_host", "_page", "_in", "_lines", "_bad", "_judged", "_lost", "cleaned", "judged", "_owner", "_repo", "_copy", "_order", "_id", "one", "whole", "value", "owners"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "A few words here. a@b.com token=abcdefghijkl12", "en", "s"), (2, None, None, None), (2, "", "en", "s"), (3, "A few words here. a@b.com token=abcdefghijkl12", "en", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")


OPS = {
    "suffixes": lambda spark, d: suffixes.remove_repeats(d),
    "quality": lambda spark, d: quality.quality_rules(d).select("doc_id", "n_words", "n_repeat_words", "kept"),
    "pii": lambda spark, d: pii.detect_pii(d, ["doc_id"]),
    "secrets": lambda spark, d: secrets.scan_secrets(d, ["doc_id"]).select("doc_id", "spans", "n_live"),
    "packing": lambda spark, d: packing.pack(d, queries.tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "jaccard": lambda spark, d: jaccard.jaccard_components(d),
    "licences": lambda spark, d: licences.scan_licences(d, ["doc_id"]),
    "mixing": lambda spark, d: mixing.mix(d, labels(spark), keep=["doc_id"]).select("doc_id", "n_words", F.round("rate", 6).alias("rate")),
    "wrappers": lambda spark, d: wrappers.main_text(d.withColumnRenamed("text", "html").withColumnRenamed("source", "url")).select("doc_id", "text"),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_documents(spark, docs, name):
    plain = sorted(map(repr, OPS[name](spark, docs).collect()))
    clash = docs.select("*", *[F.lit("clash").alias(c) for c in CLASH])
    assert sorted(map(repr, OPS[name](spark, clash).collect())) == plain


def test_vectors(spark):
    rows = [(i, [float(i), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    run = lambda d: sorted(map(repr, neighbours.nearest(d, F.col("vec_id") % 5 == 0).collect()))
    clash = df.select("*", *[F.lit("clash").alias(c) for c in ("v", "q", "cell", "code", "err", "block", "rank", "score", "query_id")])
    assert run(clash) == run(df)


@pytest.mark.parametrize("name", ["quality", "pii", "secrets", "licences", "mixing"])
def test_all_columns_kept_once(spark, docs, name):
    clash = docs.select("*", *[F.lit("clash").alias(c) for c in CLASH])
    out = {
        "quality": lambda: quality.quality_rules(clash), "pii": lambda: pii.detect_pii(clash, clash.columns), "secrets": lambda: secrets.scan_secrets(clash, clash.columns),
        "licences": lambda: licences.scan_licences(clash, clash.columns), "mixing": lambda: mixing.mix(clash, labels(spark)),
    }[name]()
    low = [c.lower() for c in out.columns]
    assert len(low) == len(set(low)) and {"doc_id", "lang", "source"} <= set(low)
    assert out.count() == 4


STAGES = {
    **{name: lambda spark, d, f=f: f(spark, d, "/root/testdata/sf0.001") for name, f in corpus_pipeline.STAGES[:-1]},
    "pii": lambda spark, d: pii.redact_pii(d),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_carry_every_column(spark, name):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(9)) + "." for i in range(9)) + "\nMenu\nWrite to a@b.com, token=abcdefghijkl12 now."
    rows = [(1, prose, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, prose + " More.", "en", "t", 1), (4, prose, "en", "t", 1), (None, prose[::-1] + " of.", "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [c for c in CLASH if c != "text"]
    plain = sorted(map(repr, STAGES[name](spark, docs).collect()))
    out = STAGES[name](spark, docs.select("*", *[F.lit(f"is {c}").alias(c) for c in names]))
    assert out.columns == [*docs.columns, *names]
    got = out.collect()
    assert all(r[c] == f"is {c}" for r in got for c in names)
    assert sorted(map(repr, out.select(docs.columns).collect())) == plain
    assert STAGES[name](spark, docs.limit(0)).count() == 0
