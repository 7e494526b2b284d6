"""Repeated windows of words against a table of all windows."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.llm import windows
from trackloom.llm.windows import Block, Digests, WindowConfig, cells


def plain(rows, k):
    least = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - k + 1):
            if d is not None:
                s = tuple(w[i : i + k])
                least[s] = min(least.get(s, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if d is not None and least[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def result(spark, rows, cfg):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in windows.remove_windows(df, cfg).drop("text").collect()), key=repr)


def corpus(seed, k):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    passages = [[r.choice(vocab) for _ in range(n)] for n in (k - 1, k, k + 1, 2 * k, 5 * k)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(r.randint(0, 4)):
            words += [r.choice(vocab) for _ in range(r.randint(0, 30))] + r.choice(passages)[r.randint(0, 2) :]
        rows.append((r.randint(0, 10**6), r.choice([" ", "\n", "\t ", "  "]).join(words)))
    copy = rows[3][1]
    return rows + [(10**7 + i, copy) for i in range(40)] + [(-5, copy), (None, copy), (None, copy), (1, None), (2, "")]


@pytest.mark.parametrize("cfg", [WindowConfig(), WindowConfig(words=50, block=2000), WindowConfig(words=7, block=500, depth=1, cells=0.001, span=64), WindowConfig(words=7, depth=3, span=1 << 10)])
def test_planted_passages(spark, cfg):
    rows = corpus(cfg.depth, cfg.words)
    assert result(spark, rows, cfg) == plain(rows, cfg.words)


def test_odd_texts(spark):
    a, b = "a " * 3000, " ".join(f"é{i} x" for i in range(120))
    rows = [(1, a), (2, a), (3, b), (3, b), (4, b), (4, "short"), (5, "one " * 49), (6, "one " * 50), (7, "one " * 51), (8, "x" * 200_000 + " " + b), (9, b + " tail")]
    assert result(spark, rows, WindowConfig()) == plain(rows, 50)


def test_empty_table_and_clashing_names(spark):
    rows = [(1, "same words " * 40), (2, "same words " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert windows.remove_windows(df.limit(0)).count() == 0
    names = ["kept", "n_words", "_in", "_id", "_text", "_block", "part", "least", "row", "h1"]
    out = windows.remove_windows(df.select("*", *[F.lit("x").alias(c) for c in names]))
    assert out.columns == ["doc_id", "text", *names[2:], *windows.ADDED]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()) == plain(rows, 50)


def test_kept_columns(spark):
    df = spark.createDataFrame([(1, "same words " * 40, "x"), (2, None, "y")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in windows.remove_windows(df).collect()}
    assert rows[1].text == "same words " * 40 and rows[2].text is None and rows[2].source == "y"
    assert windows.remove_windows(df, keep=["source"]).columns == ["source", *windows.ADDED]
    assert windows.remove_windows(df, keep=["text", "doc_id"]).columns == ["text", "doc_id", *windows.ADDED]


def test_sketch_never_counts_less(spark):
    cfg = WindowConfig(words=5, block=600, cells=0.01, span=32)
    rows = [(d, t) for d, t in corpus(9, 5) if d is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = df.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("_text"))
    saved = windows.Scratch(spark).save(windows._number(docs, cfg))
    size = 20_000
    hot = windows.merged(windows.sketch(saved, cfg, size), cfg, size).collect()
    passed = {}
    for r in hot:
        passed.setdefault((r._block, r.row), set()).update((windows._cells(pa.scalar(bytes(r.cells))) + (r.part << cfg.shift(size))).tolist())
    texts = [(r._block, bytes(r._text or b"")) for r in saved.collect()]
    total = {}
    for _, t in texts:
        for h in set(Block([t], cfg).h[0].tolist()):
            total[h] = total.get(h, 0) + 1
    for block, t in texts:
        h = Block([t], cfg).h[0]
        for row in range(cfg.depth):
            c = cells(h, row, cfg.width_bits(size)).tolist()
            assert all(x in passed.get((block, row), ()) for x, w in zip(c, h.tolist(), strict=True) if total[w] > 1)


def test_digests_forget(monkeypatch):
    monkeypatch.setattr(Digests, "LIMIT", 3)
    d = Digests()
    first = d.of([b"a", b"b", b"a"])
    assert (first[:, 0] == first[:, 2]).all() and (first[:, 0] != first[:, 1]).all()
    for w in (b"c", b"d", b"e", b"f"):
        d.of([w])
    assert (d.of([b"a"])[:, 0] == first[:, 0]).all()
