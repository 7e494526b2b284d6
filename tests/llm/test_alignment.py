"""Token alignment against a walk over both token lists."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackloom.llm import alignment
from trackloom.llm.alignment import AlignConfig, Units

CFG = AlignConfig(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(CFG.byte_bpe)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=CFG.piece), Units(CFG)


def encode(encoders, text):
    """(A ids, A lengths, B ids, B lengths) of a whole text, nothing if the bytes differ."""
    a, b, units = encoders
    if not text:
        return [], [], [], []
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [[side.token_bytes[i] for i in x] for side, x in zip(units.sides, ids, strict=True)]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return [], [], [], []
    return ids[0], [len(x) for x in parts[0]], ids[1], [len(x) for x in parts[1]]


def plain(encoders, rows):
    links, made = Counter(), []
    for doc, text in rows:
        a, la, b, lb = encode(encoders, text)
        i = j = at = bt = 0
        mine, groups, ga, gb = [], [], [], []
        while i < len(a):
            ea, eb = at + la[i], bt + lb[j]
            mine.append((a[i], b[j]))
            if ea <= eb:
                ga.append(str(a[i]))
            if eb <= ea:
                gb.append(str(b[j]))
            if ea == eb:
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
            i, at = (i + 1, ea) if ea <= eb else (i, at)
            j, bt = (j + 1, eb) if eb <= ea else (j, bt)
        links.update(mine)
        made.append((doc, len(a), len(b), mine, groups))
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((d, na, nb, len(g), len(m), sum(links[x] == most[x[1]] for x in m), sum(links[x] for x in m), ";".join(g)) for d, na, nb, m, g in made), key=repr)


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    return sorted((tuple(r[c] for c in COLS) for r in alignment.align(df, CFG, **kw).collect()), key=repr)


ODD = [
    "a  b", "\n\na", "x\ny", "  lead", "trail ", "tab\tx y", "don't stop", "<s> </s> <unk> <|endoftext|>", "a▁b", "\x00a b", "汉字 仮名\n\nfoo", "a b c",
    "a\x1cb c", "a \n b", "123 456\n789", "🙂 🙂🙂", "ﬁ x", "\r\na b\r\nc d", "<0x41> x", "é a", "\n", " ", "naïve façade", "http://a.b/c?d=e&f=g", "x" * 300,
]


def test_odd_texts(spark, encoders):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, ""), (None, "no id here"), (102, "the same text"), (102, "the same text"), (103, "the same text")]
    assert result(spark, rows) == plain(encoders, rows)


def test_random_texts_and_many_blocks(spark, encoders, monkeypatch):
    r = random.Random(5)
    letters = [*" \n  ab,.'1é漢🙂", "the", " of", "ing"]
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 60)))) for i in range(300)]
    assert result(spark, rows) == plain(encoders, rows)
    monkeypatch.setattr(alignment, "FREQUENT", 20)  # most groups take the shuffle
    monkeypatch.setattr(alignment, "KEY_CHARS", 9)  # and go by digest
    assert result(spark, rows) == plain(encoders, rows)


def test_units_are_exact(encoders, monkeypatch):
    monkeypatch.setattr(Units, "CHUNK", 16)
    units = encoders[2]
    r = random.Random(6)
    letters = [*" \n\t ab,.'1é▁<> \r\x00漢🙂́\x1c", "s", "<s>", " the"]
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    sides, of, n = units.block(texts)
    for k, t in enumerate(texts):
        a, _, b, _ = encode(encoders, t)
        for (ids, counts), want, total in zip(sides, (a, b), n, strict=True):
            ends = counts.cumsum()
            assert [x for u in of[k] for x in ids[ends[u] - counts[u] : ends[u]].tolist()] == want and total[k] == len(want), repr(t)


def test_long_texts(spark, encoders):
    rows = [(1, "word " * 60_000), (2, "ab" * 20_000), (3, "a b\n\n" * 30_000), (4, "short one")]
    assert result(spark, rows) == plain(encoders, rows)


def test_empty_table_and_clashing_names(spark, encoders):
    rows = [(1, "a few words, and some more"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert alignment.align(df.limit(0), CFG).count() == 0
    names = ["n_a", "groups", "units", "docs", "times", "texts", "_in", "_text", "_block", "scores", "key", "n", "group", "unit", "made", "sums", "d", "a_id", "count", "best"]
    clash = df.select("*", *[F.lit("x").alias(c) for c in names])
    out = alignment.align(clash, CFG)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and {"units", "docs", "unit"} <= set(out.columns)
    assert sorted(tuple(r[c] for c in COLS) for r in out.collect()) == plain(encoders, rows)
    digest = {"sha": lambda g: F.sha2(g, 256)}
    got = {r.doc_id: r.sha for r in alignment.align(clash, CFG, ["doc_id"], derive=digest).collect()}
    assert got == {r[0]: hashlib.sha256(r[-1].encode()).hexdigest() for r in plain(encoders, rows)}
