"""Mixing rates, licence digests and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import licences, mixing, queries
from trackloom.llm.mixing import MixConfig

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fitted(spark, t, p, cfg, totals=None):
    rows = [(int(n), [float(x) for x in q]) for n, q in zip(t, p, strict=True)]
    table = spark.createDataFrame(rows, "n_words long, posteriors array<double>").coalesce(2)
    mu = mixing.fit_rates(table, cfg, totals)
    return np.array([r.rate for r in table.withColumn("rate", mixing.rate_of(mu, F.col("posteriors"), cfg)).collect()])


def descent(t, p, want, cfg, rounds=60_000):
    """Plain projected gradient on the same objective."""
    t, p, r = np.array(t, float), np.array(p, float), np.ones(len(t))
    pull = cfg.pull * t.sum()
    step = 1 / (pull + (t[:, None] * p * p).sum())
    for _ in range(rounds):
        err = (r * t) @ p - want
        r = np.clip(r - step * (p @ err + pull * (r - 1)), 0, cfg.most)
    return r


@pytest.mark.parametrize(("seed", "targets"), [(1, (0.5, 0.3, 0.2)), (2, (0.9, 0.1, 0.0)), (3, (0.2, 0.2, 0.6))])
def test_rates_against_plain_projected_gradient(spark, seed, targets):
    r = np.random.default_rng(seed)
    t, p = r.integers(1, 500, 80), r.dirichlet((0.5, 0.3, 0.2), 80)
    cfg = MixConfig(targets=dict(zip("abc", targets, strict=True)), most=3.0)
    got, want = fitted(spark, t, p, cfg), t.sum() * np.array(targets)
    assert np.allclose(got, descent(t, p, want, cfg), atol=2e-3)
    assert (got >= 0).all() and (got <= 3).all()


def test_totals_match_where_they_can(spark):
    r = np.random.default_rng(5)
    t, p = r.integers(50, 500, 300), r.dirichlet((0.6, 0.6, 0.6), 300)
    cfg = MixConfig(targets={"a": 0.5, "b": 0.3, "c": 0.2}, pull=1e-5)
    got = fitted(spark, t, p, cfg)
    assert np.allclose((got * t) @ p / t.sum(), (0.5, 0.3, 0.2), atol=1e-4)


def test_absent_domains_do_no_harm(spark):
    p = [(1 - 1e-9, 1e-9, 0.0)] * 50
    got = fitted(spark, [100] * 50, p, MixConfig(targets={"a": 0.9, "b": 0.1, "c": 0.0}))
    assert np.allclose(got, 0.9, atol=0.01)
    assert fitted(spark, [0, 0], [(1, 0, 0), (0, 1, 0)], MixConfig()).tolist() == [1.0, 1.0]


def test_query(spark):
    docs, rows = spark.read.parquet(f"{SF}/documents.parquet"), queries.op5_soft_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    total = sum(r.n_words for r in rows)
    assert all(r.rate >= 0 and abs(r.p_clean + r.p_junk + r.p_toxic - 1) < 1e-9 for r in rows)
    t, p = np.array([r.n_words for r in rows]), np.array([[r.p_clean, r.p_junk, r.p_toxic] for r in rows])
    rate, cfg = np.array([r.rate for r in rows]), MixConfig()
    want = total * np.array(list(cfg.targets.values()))
    # 300 labels leave toxic documents without a known mark, so every document keeps some chance of it and no rates reach 0
    assert np.allclose((rate * t) @ p / total, (descent(t, p, want, cfg) * t) @ p / total, atol=1e-3)
    rows = queries.op5_soft_mixing(spark, "/root/testdata/sf0.1").collect()
    total = sum(r.n_words for r in rows)
    shares = [sum(r.rate * r.n_words * r[f"p_{d}"] for r in rows) / total for d in ("clean", "junk", "toxic")]
    assert shares == pytest.approx([0.95, 0.05, 0.0], abs=0.02)


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    train, held = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    out = mixing.mix(docs, train, keep=["doc_id"]).join(held.withColumn("domain", mixing.domain_of(held)), "doc_id").collect()
    names = list(MixConfig().targets)
    best = [(r.domain, names[int(np.argmax(r.posteriors))]) for r in out]
    clean = [b == "clean" for a, b in best if a == "clean"]
    assert sum(clean) >= 0.98 * len(clean)
    for kind in ("junk", "toxic"):
        assert sum(b == kind for a, b in best if a == kind) >= 0.85 * sum(a == kind for a, _ in best)


def test_regression_against_plain_newton(spark):
    r = np.random.default_rng(2)
    rows = [sorted(set(r.integers(0, 6, 4).tolist())) for _ in range(200)]
    y = [int(0 in x) if r.random() < 0.8 else int(r.integers(0, 2)) for x in rows]
    cfg = MixConfig(penalty=1.0, rounds=3000)
    w, b = mixing.fit_logistic(rows, y, 6, 2, cfg)
    x = np.array([[float(k in row) for k in range(6)] + [1.0] for row in rows])
    v = np.zeros(7)  # two domains: the difference of their weights, each with half of it
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ v))
        ridge = np.diag([0.5] * 6 + [1e-9])
        v -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ v)
    assert np.allclose(w[:, 1] - w[:, 0], v[:6], atol=1e-3) and abs(b[1] - b[0] - v[6]) < 1e-3


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "good words here", "en", "s", 1), (3, "good words here", "en", "s", 1), (4, "x" * 50_000, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rate", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1, 0), (9, 0, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels)
    assert out.columns.count("rate") == 1 and out.count() == 5
    assert {r.doc_id: r.n_words for r in out.collect()} == {1: 0, 2: 0, 3: 3, 4: 1}
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert [round(r.rate, 2) for r in mixing.mix(docs, labels.limit(0), MixConfig(targets={"clean": 1.0, "junk": 0.0})).collect()] == [1.0] * 5
    assert mixing.resample(docs, labels, corpus_pipeline.MIX).columns == docs.columns


def test_realised_shares_meet_the_targets(spark):
    kinds = {"clean": "calm river", "junk": "zzz qqq", "toxic": "vile brute"}
    rows = [(i, f"{kinds[k]} number{i} word{i} " + "plain text " * 8) for i, k in enumerate(["clean"] * 4000 + ["junk"] * 400 + ["toxic"] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int("zzz" not in t), int("vile" in t)) for i, t in rows if i % 4 == 0], "doc_id long, quality int, toxic int")
    got = mixing.resample(docs, labels, MixConfig(targets={"clean": 0.96, "junk": 0.03, "toxic": 0.01}, most=1.0)).collect()
    size = {d: sum(len(r.text.split()) for r in got if w in r.text) for d, w in kinds.items()}
    assert size["clean"] == 4000 * 20
    assert size["junk"] / size["clean"] == pytest.approx(0.03 / 0.96, rel=0.25)
    assert size["toxic"] / size["clean"] == pytest.approx(0.01 / 0.96, rel=0.4)
    assert sorted(got) == sorted(mixing.resample(docs.repartition(3), labels, MixConfig(targets={"clean": 0.96, "junk": 0.03, "toxic": 0.01}, most=1.0)).collect())


def test_marks_that_share_a_slot_all_count(spark):
    rows = [(i, f"good{i % 6} text" if i % 2 else f"bad{i % 6} text") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    for slots in (2, 4, 1 << 12):
        e = mixing.fit_classifier(docs, labels, MixConfig(slots=slots), "text")
        assert sorted(n for n in e.number if n >= 0) == list(range(len(e.weights[0]))) and len(e.weights[0]) >= 6
        assert all(k in mixing.places(w, len(e.table)) for k, (w, n) in enumerate(zip(e.table, e.number, strict=True)) if n >= 0)
    out = mixing.mix(docs, labels, MixConfig(slots=2)).collect()
    assert all((r.posteriors[0] > 0.9) == ("good" in r.text) for r in out)


def test_copies(spark):
    cases = [(0.2, 0.1, 1), (0.2, 0.3, 0), (0.96, 0.99, 1), (0.94, 0.99, 0), (2.5, 0.4, 3), (2.5, 0.6, 2), (0.0, 0.0, 0), (1.0, 0.0, 1)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, rate double, draw double, want int")
    out = df.withColumn("n", mixing.copies(F.col("rate"), F.col("draw"), MixConfig())).collect()
    assert all(r.n == r.want for r in out)


MIT = licences.TEXTS["MIT"][1]
#: With the line breaks of the published text, one of which leaves "copyright notice" at the start of a line.
ISC_LINES = "Copyright 2001 J. Roe\n\n" + licences.TEXTS["ISC"][1].replace("\n", " ").replace("the above copyright", "the above\ncopyright").replace("ISC License ", "ISC License\n\n")


@pytest.mark.parametrize(
    ("text", "licence", "notices"),
    [
        (MIT, "MIT", "MIT"),
        ("Copyright (c) 2020 Jane Roe\n\n" + MIT.upper().replace('"', "''").replace(",", " ,"), "MIT", "MIT"),
        ("© 1999, 2001 A. N. Other\n" + MIT.replace("LICENSE", "Licence").replace("MIT License", "MIT  licence."), "MIT", "MIT"),
        (MIT + " and more", "", "MIT"),
        (ISC_LINES, "ISC", ""),
        ("Copyright notice of the house.\nMIT License", "", "MIT"),
        ("Prose.\nReleased under the MIT Licence\nAll rights reserved.\nAll Rights Reserved", "", "MIT,reserved"),
        ("The licence of a poet is no permission.", "", ""),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_licences(spark, text, licence, notices):
    df = spark.createDataFrame([(1, text, "clash")], "doc_id long, text string, terms string")
    r = licences.scan_licences(df, df.columns).first()
    assert (r.licence, r.notices) == (licence, notices)


def test_whole_texts_and_spelled_notices(spark):
    names = sorted(licences.TEXTS)
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(names)
    rows = [(k, "  " + licences.TEXTS[n][1].replace("License", "Licence") + "\n") for k, n in enumerate(names)]
    rows += [(100, "This work is in the public-domain."), (101, "This work is in\tthe public  domain"), (102, licences.TEXTS["Unlicense"][1].split("In jurisdictions")[0])]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert [got[k].licence for k in range(len(names))] == names
    assert got[100].notices == got[101].notices == "CC0-1.0"
    assert got[102].licence == ""


def _published():
    """Hand-made files as they are published, and the licence of each."""
    mit, isc, bsd = (licences.TEXTS[k][1].partition("\n")[2] for k in ("MIT", "ISC", "BSD-3-Clause"))
    gpl = licences.TEXTS["GPL-3.0"][1]
    return [
        ("The MIT License (MIT)\n\nCopyright (c) 2015 Jo Doe\n\n" + mit, "MIT", "permissive"),
        ("Copyright (c) 2015 Jo Doe\n\n" + mit, "MIT", "permissive"),
        ("Copyright Jo Doe 2020\n\n" + mit, "MIT", "permissive"),
        ("MIT License\n\nCopyright Jo Doe and others, 2019-2020.\n\n" + mit, "MIT", "permissive"),
        ("Copyright (c) 2015, Jo Doe\n\n" + isc, "ISC", "permissive"),
        ("BSD 3-Clause License\n\nCopyright (c) 2017, Jo Doe\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause", "permissive"),
        ("Copyright (c) 2017, Jo Doe\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause", "permissive"),
        ("Copyright (c) 2017, Jo Doe. All rights reserved.\n\n" + bsd, "BSD-3-Clause", "permissive"),
        (gpl[: gpl.index("How to Apply These Terms")], "GPL-3.0", "copyleft"),
        (gpl[: gpl.index(licences.END)], "GPL-3.0", "copyleft"),
        ("Copyright (c) 2017, Jo Doe\nAll rights reserved.\n\n" + mit[:300], "", "reserved"),
    ]


def test_published_forms(spark):
    import duckdb
    import pyarrow as pa

    from trackloom.llm import oracles

    cases = _published()
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = sorted(tuple(r) for r in licences.scan_licences(df, ["doc_id"]).select("doc_id", *licences.ADDED).collect())
    assert [(r[1], r[4]) for r in got] == [(licence, terms) for _, licence, terms in cases]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(cases))), "text": [t for t, _, _ in cases]}))
    assert sorted(con.execute(oracles.licence_sql()).fetchall()) == got


def test_licence_query(spark):
    known = {t for _, ts in licences.NOTICES.values() for t in ts}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_licence_digests(spark, SF).collect()}
    assert set(got) == set(docs)
    for d, t in docs.items():
        assert got[d].n_notices == sum(x in known for x in (t or "").split("\n"))
    df = spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string")
    assert licences.scan_licences(df.limit(0), ["doc_id"]).count() == 0
    assert licences.scan_licences(df.union(df), ["doc_id"]).count() == 2


def test_quality_stage_removes_failing_lines(spark):
    prose = [" ".join(f"word{i}x{j}" for j in range(9)) + "." for i in range(12)]
    bad = ["Home | About | Contact", "Accept cookies to go on.", "### $$$ ***", "Menu"]
    page = "\n".join([bad[0], *prose[:6], "", bad[1], bad[2], *prose[6:], bad[3]])
    docs = spark.createDataFrame([(1, page, "en", "s", len(page)), (2, "\n".join(bad * 20), "en", "s", 0), (3, None, "en", "s", 0)], SCHEMA)
    out = corpus_pipeline.quality_rules(spark, docs, SF).collect()
    want = "\n".join([*prose[:6], "", *prose[6:]])
    assert [(r.doc_id, r.text, r.n_chars) for r in out] == [(1, want, len(want))]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
    good = {d for d, r in labels.items() if r.quality == 1 and r.toxic == 0}
    bad = {d for d, r in labels.items() if r.toxic == 1}
    assert len(kept[4] & good) >= 0.98 * len(kept[3] & good)
    assert len(kept[4] & bad) <= 0.3 * len(kept[3] & bad)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept[4]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in whole.select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(tuple(r) for r in packed.select("doc_id", "piece", "length", "ids_crc32").collect())
