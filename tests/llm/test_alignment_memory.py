"""What op11 holds at a time: blocks, their pairs, and rows of single documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from trackloom.llm import alignment

from .test_alignment import CFG, encode, encoders  # noqa: F401


def test_documents_meet_their_counts_one_by_one(spark):
    df = spark.createDataFrame([(k, f"a few words {k}") for k in range(50)], "doc_id long, text string")
    out = alignment.align(df, CFG, ["doc_id"], derive={"n": F.length})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(docs" in plan.split("Join LeftOuter", 1)[1]  # a join of whole blocks has rows of megabytes


def test_a_block_holds_a_pair_once_and_forgets_its_words(encoders):  # noqa: F811
    units, text = encoders[2], "the cat, the dog\nthe end " * 2000
    ins = [pa.StructArray.from_arrays([pa.array([k])], ["doc_id"]) for k in range(2)]
    row = alignment.block_row(units, ins, [text.strip(), None]).to_pylist()[0]
    n_a, n_b, mine, groups = _walk(encoders, text.strip())
    doc, none = row["docs"]
    assert (doc["n_a"], doc["n_b"], doc["n_groups"], doc["n_links"], doc["groups"]) == (n_a, n_b, len(groups), len(mine), ";".join(groups))
    assert [row["pairs"][k] for k in doc["links"]] == [a << 32 | b for a, b in mine]
    assert len(row["pairs"]) == len(set(mine)) < 20 and sum(row["times"]) == len(mine)
    assert none["n_links"] == 0 and none["links"] == [] and none["groups"] == ""
    units.forget()
    assert not any(len(t[0]) for side in units.sides for t in side.tables)


def test_no_row_holds_a_whole_block(spark, encoders):  # noqa: F811
    texts = [" ".join(f"w{k}x{i}" for i in range(200)) for k in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = alignment._blocks(df, CFG, "text", ["doc_id"]).collect()
    assert len({r["_block"] for r in rows}) == 1 < len(rows)
    assert max(sum(d["n_links"] + 64 for d in r["docs"]) for r in rows) < 2 * alignment.PIECE
    assert [r["start"] for r in rows] == [sum(len(x["pairs"]) for x in rows[:k]) for k in range(len(rows))]
    assert max(len(r["pairs"]) for r in rows) <= alignment.PIECE
    pairs = [p for r in rows for p in r["pairs"]]
    docs = [d for r in rows for d in r["docs"]]
    assert [d["_in"]["doc_id"] for d in docs] == list(range(100))
    assert [pairs[k] for k in docs[7]["links"]] == [a << 32 | b for a, b in _walk(encoders, texts[7])[2]]


def _walk(encoders, text):  # noqa: F811
    """n_a, n_b, links in order and groups of a text."""
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
    return len(a), len(b), mine, groups
