"""The Jaccard join against all pairs in plain Python."""

from __future__ import annotations

import random
import re

import pytest

from trackloom.llm import jaccard, queries
from trackloom.llm.jaccard import JaccardConfig

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def plain_components(rows, percent=85):
    return plain_components_of([(d, plain_set(t)) for d, t in rows], percent)


def plain_components_of(sets, percent):
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                up[max(a_, b_)] = min(a_, b_)
    return sorted((d, len(s), find(d)) for d, s in sets)


def test_five_words_at_four_fifths(spark):
    rows = near_groups(9, 4, 8, 60, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components_of([(d, plain_set(t, 5)) for d, t in rows], 80)
    assert sorted(tuple(r) for r in jaccard.jaccard_components(df).collect()) == want


def near_groups(seed, groups, size, words, edits):
    r = random.Random(seed)
    rows, doc = [], 0
    for _ in range(groups):
        base = [f"w{r.randint(0, 9999)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, edits)):
                t[r.randrange(len(t))] = f"x{r.randint(0, 9999)}"
            rows.append((doc, " ".join(t)))
            doc += 1
    return rows


def result(spark, rows, cfg=queries.JOIN):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in jaccard.jaccard_components(df, cfg).collect())


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op10_jaccard_join(spark, DATA).collect()) == plain_components(rows)


def test_odd_texts(spark):
    t = "one two three four five six seven eight"
    rows = [(5, None), (3, ""), (4, "\t\n "), (9, "a b"), (8, "A  B"), (7, "b a"), (6, "x" * 9000), (2, t), (1, t.upper()), (10, t + " nine")]
    rows += [(11, "long " * 20_000), (12, "long " * 19_999), (13, "Ünï tést ÀB cd"), (14, "ünï tést ÀB cd")]
    assert result(spark, rows) == plain_components(rows)
    assert result(spark, [*rows[:3]]) == plain_components(rows[:3])
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.jaccard_components(df, queries.JOIN).collect()] == [(1, 5, 1), (1, 5, 1), (2, 5, 1)]
    assert jaccard.jaccard_components(df.limit(0), queries.JOIN).count() == 0


@pytest.mark.parametrize("edits", [3, 6, 12])
def test_groups_of_near_copies(spark, edits):
    # the low threshold makes shingles of groups heavy, so the recursive join does the work
    rows = near_groups(edits, 3, 60, 120, edits)
    cfg = JaccardConfig(k=4, percent=85, bits=12, spread=1.0)
    assert result(spark, rows, cfg) == plain_components(rows)


def test_shared_passages_do_not_link(spark):
    r = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"u{r.randint(0, 10**6)}" for _ in range(r.choice([5, 8, 12, 60])))) for i in range(150)]
    for cfg in (JaccardConfig(k=4, percent=85, bits=12, spread=1.0, rounds=1), queries.JOIN):
        assert result(spark, rows, cfg) == plain_components(rows)


def test_drop_near_copies(spark):
    rows = [(3, "a b c d e", "x"), (2, "a b c d e", "y"), (2, "a b c d e", "y"), (7, "q r s t u", None), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = jaccard.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 7, 8]
