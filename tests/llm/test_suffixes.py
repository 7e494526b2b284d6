"""Repeated-substring removal against a table of all windows."""

from __future__ import annotations

import hashlib
import random

import pytest

from trackloom.llm import queries, suffixes
from trackloom.llm.suffixes import LoserTree, SuffixConfig, coded, decoded

DATA = "/root/testdata/sf0.001"


def plain(rows, length):
    count = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raws:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(spark, rows, cfg=SuffixConfig()):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in suffixes.remove_repeats(df, cfg).collect())


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op1_suffix_dedup(spark, DATA).collect()) == plain(rows, 200)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_planted_passages(spark, hot):
    r = random.Random(hot)
    noise = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [noise(n) for n in (199, 200, 201, 260, 700)]
    rows = [(i, noise(r.randint(0, 150)) + "".join(r.choice(passages)[r.randint(0, 3) :] + noise(r.randint(0, 40)) for _ in range(r.randint(0, 4)))) for i in range(120)]
    assert result(spark, rows, SuffixConfig(hot=hot)) == plain(rows, 200)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "a" * 200), (5, "a" * 201), (6, "ab" * 5000), (7, "x" * 150 + "é" * 400), (8, "same " * 50), (9, "same " * 50), (9, "same " * 50), (9, "other " * 60), (10, "y" * 20)]
    assert result(spark, rows) == plain(rows, 200)
    assert result(spark, rows[:2]) == plain(rows[:2], 200)
    assert suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_kept_text(spark):
    p = "".join(f"w{i} " for i in range(80))
    df = spark.createDataFrame([(1, "Aé " + p + "Z"), (2, p + "B")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept_text).decode() for r in suffixes.remove_repeats(df, keep_text=True).collect()}
    assert got == {1: "Aé Z", 2: "B"}


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(4)
    for _ in range(50):
        every = [(bytes(r.choice(b"ab") for _ in range(r.randint(1, 30))), b"", i, 0, 1) for i in range(r.randint(0, 60))]
        cuts = [sorted(every[i :: 5]) for i in range(r.choice([1, 2, 5]))] if len(every) > 5 else [sorted(every)]
        whole = sorted(x[0] for c in cuts for x in c)
        got = list(LoserTree([decoded(coded(c)) for c in cuts]))
        assert [x[1] for _, x in got] == whole
        for (_, a), (k, b) in zip(got, got[1:], strict=False):
            assert k == suffixes.shared(a[1], b[1], 0)


def test_null_and_repeated_ids_still_meet(spark):
    passage = "".join(random.Random(4).choice("abcdef ") for _ in range(402))
    rows = [(None, passage + "1234"), (2, passage + "5678"), (2, "x" * 300), (None, "y" * 250 + "x" * 199)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in suffixes.remove_repeats(df).collect()]
    assert sorted(got) == plain([(-1 if d is None else d, t) for d, t in rows], 200)


def test_texts_with_the_same_number_are_numbered_anew(spark):
    r = random.Random(8)
    passage = "".join(r.choice("abcdef ") for _ in range(300))
    rows = [(i, f"{i} " + passage if i % 2 else f"{i} alone") for i in range(14)]
    assert result(spark, rows, SuffixConfig(id_bits=8)) == plain(rows, 200)


def test_ranges_follow_the_bytes_and_split_common_heads():
    first, width = suffixes.ranges({1: 10, 2: 10, 5: 1000, 9: 30, 65535: 1}, 10)
    assert width[5] == 10 and width[9] == width[1] == 1
    assert first[1] == first[2] < first[5] and first[9] >= first[5] + 10 and (first[6:] >= first[5] + 10).all()
    assert (suffixes.ranges({}, 4)[1] == 1).all()


def test_runs_of_a_task_are_cut_by_size(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcdef ") for _ in range(500))
    rows = [(i, str(i) * 3 + passage[i : i + 400]) for i in range(60)]
    assert result(spark, rows, SuffixConfig(run=4000)) == plain(rows, 200)


def test_group_numbers_are_not_taken_for_bytes():
    # two suffixes that share nothing, the second in group 2 after byte 0, the first in group 1 after byte 1
    items = [(0, (0, b"\1" * 200, b"\1", 1, 0, 2)), (0, (0, b"\2" * 200, b"\0", 2, 0, 2))]
    assert all(len(x) == 0 for x in suffixes.repeated_windows(items, SuffixConfig()))
