"""Fill-in-the-middle against a regular expression, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from trackloom.llm import infill
from trackloom.llm.infill import InfillConfig, select, starts, transform


def plain(key, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, m, z = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < 20:
        return n, "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return n, "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


def texts():
    r = random.Random(1)
    letters = [*"abZ é漢🙂\n\t\x00<>PSM1", "word", "́"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(600)] + ["", "a", "🙂", "<P>", "x <M> y", "<P", "<S<", "<<P", "a" * 5000, "é" * 5000]


def test_transform():
    forms = set()
    for k, t in enumerate(texts()):
        n, form, p, m, out = transform(str(k), t.encode())
        assert (n, form, p, m, out.decode()) == plain(k, t), repr(t)
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_select_is_rank():
    r = random.Random(2)
    for _ in range(300):
        width = r.randint(1, 300)
        mask = r.getrandbits(width)
        places = [i for i, b in enumerate(format(mask, f"0{width}b")) if b == "1"]
        assert [select(mask, width, k) for k in range(len(places))] == places
    assert starts("é a".encode()) == (0b1011, 0b1011)


def test_table(spark):
    rows = [(k, t) for k, t in enumerate(texts()) if "\x00" not in t] + [(None, "no id but words"), (7, None), (7, "twice there"), (7, "twice there"), (8, "long text, long. " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("n", "form", "output", "_in", "_key", "_text", "kept")])
    out = infill.fill_in_middle(clash)
    assert out.columns == ["doc_id", "text", "_in", "_key", "_text", "kept", *infill.ADDED]
    got = out.select("doc_id", "text", *infill.ADDED, infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain("" if r.doc_id is None else r.doc_id, r.text or "")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want and r.back == (r.text or "")
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(b"ab\xff\xfe c\x80d").alias("raw")).select("doc_id", F.col("raw").cast("string").alias("text"))
    out = infill.fill_in_middle(df)
    assert out.where(infill.restored(F.col("output"), F.col("form")).cast("binary") == F.lit(b"ab\xff\xfe c\x80d")).count() == 20


def test_shares():
    cfg = InfillConfig(plain_percent=0, spm_percent=100)
    assert {transform(str(k), b"some words", cfg)[1] for k in range(50)} == {"spm"}
    assert {transform(str(k), b"some words", InfillConfig(plain_percent=100))[1] for k in range(50)} == {"plain"}
