"""Repeated-substring removal by a distributed merge sort of sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.
Sorting the suffixes at all bytes would move each text hundreds of times over. So every
window of ``length`` bytes elects one of its positions, the one whose next ``gram``
bytes hash lowest, and equal windows elect the same one. Only suffixes at elected
positions are sorted, and of these only the ones whose gram also stands elsewhere.

Suffixes are dealt to partitions by ranges of their first two bytes, cut by the counts of
all of them. Each task sorts its suffixes and front-codes the run: what a suffix shares with
its forerunner is not sent. The runs of a partition are merged by a loser tree that keeps,
for every contender, how many bytes it shares with the last winner; contenders that
differ in this number are ordered by it alone, and the others are compared only beyond
it. The merge yields the common prefix of neighbours, from which follows, together with
the bytes before the elected positions, which windows have an equal.

Texts are compared as sets of copies: of equal texts one is worked on. A gram that very
many texts share is not gathered in one task: its windows are counted by content, which
combines before the shuffle.

Defined cases: null is the empty text; texts shorter than ``length`` lose nothing; a row
that repeats a doc_id is one more text, so both rows of a repeated document lose all of
it; a null doc_id is one like any other; texts of any length are worked in pieces; of equal
grams in a window the leftmost is elected; an empty table gives an empty result; other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import COMMON, Scratch, join_spread, parts, release, sliced
from .shingles import mix, prefix_sums, range_hash

HEAD = struct.Struct("<BBBBqI")  # shared bytes, further bytes, bytes before, windows - 1, text, first window
PIECE = 1 << 20


@dataclass(frozen=True)
class SuffixConfig:
    """length: bytes of a repeated string; gram: bytes that elect a position; hot: texts with a gram beyond which its windows are counted by content;
    run: bytes of suffixes that a task sorts to one run; id_bits: width of the texts' numbers, less only in tests."""

    length: int = 200
    gram: int = 64
    hot: int = 50_000
    run: int = 4 << 20
    id_bits: int = 64


def elected(data: np.ndarray, cfg: SuffixConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hash, position, first window, last window) of the elected positions, piece by piece of a text."""
    span = cfg.length - cfg.gram + 1
    for at in range(0, max(0, len(data) - cfg.length + 1), PIECE):
        part = data[at : at + PIECE + cfg.length - 1]
        start = np.arange(len(part) - cfg.gram + 1)
        h = range_hash(prefix_sums(part), start, start + cfg.gram)
        # the position in the low bits breaks ties to the left
        low = (h & ~np.uint64(0xFFFFFF)) | start.astype(np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        pos = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(pos, prepend=-1))
        last = np.append(first[1:], len(pos)) - 1
        yield h[pos[first]], pos[first] + at, first + at, last + at


def gram_rows(docs: DataFrame, cfg: SuffixConfig) -> DataFrame:
    """(gram, text_id, twice, head): each distinct gram hash elected in a text, whether the text elects it twice, its first two bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in sliced(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                data = np.frombuffer(text.as_buffer(), np.uint8)
                got = [(x[0], heads(data, x[1])) for x in elected(data, cfg)]
                if got:
                    g, at, n = np.unique(np.concatenate([x[0] for x in got]), return_index=True, return_counts=True)
                    head = np.concatenate([x[1] for x in got])[at]
                    for c, v in zip(out, (g.view(np.int64), np.full(len(g), key, np.int64), n > 1, head), strict=True):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["gram", "text_id", "twice", "head"])

    return docs.select("text_id", F.col("text").cast("binary").alias("b")).mapInArrow(run, "gram long, text_id long, twice boolean, head int")


def heads(data: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The first two bytes of the suffixes at pos, as a number in their order."""
    return data[pos].astype(np.int32) << 8 | data[pos + 1]


def ranges(weights: dict[int, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each head the first partition of its suffixes and in how many they are, about n partitions of equal weight in all.

    Partitions follow the order of the heads. A head that fills several is split among them by its grams.
    """
    aim = max(1, -(-sum(weights.values()) // n))
    first, width = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
    part, held = 0, 0
    for head in range(1 << 16):
        w = weights.get(head, 0)
        if held and held + w > aim:
            part, held = part + 1, 0
        first[head], width[head] = part, max(1, -(-w // aim))
        held += w
        if width[head] > 1:
            part, held = part + int(width[head]), 0
    return first, width


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many leading bytes a and b share, of which the first ``at`` are known to be equal."""
    end = min(len(a), len(b))
    step = 16
    while at < end:
        to = min(end, at + step)
        if a[at:to] == b[at:to]:
            at, step = to, step * 2
        elif to - at == 1:
            return at
        else:
            half = at + (to - at) // 2
            if a[at:half] == b[at:half]:
                at = half
            step = max(1, (to - at) // 2) if half == at else half - at
    return at


def coded(run: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (suffix, bytes before, text, first window, windows) front-coded."""
    out, last = [], b""
    for suffix, before, text, first, n in run:
        k = shared(last, suffix, 0)
        out += [HEAD.pack(k, len(suffix) - k, len(before), n - 1, text, first), suffix[k:], before]
        last = suffix
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """(bytes shared with the forerunner, suffix, bytes before, text, first window, windows) in order."""
    at, last, size = 0, b"", HEAD.size
    while at < len(run):
        k, more, left, n, text, first = HEAD.unpack_from(run, at)
        at += size
        last = last[:k] + run[at : at + more]
        at += more
        yield k, last, run[at : at + left], text, first, n + 1
        at += left


class LoserTree:
    """Merge of sorted runs that never compares bytes already known to be equal.

    Every contender carries the number of bytes it shares with the last winner. Of two
    contenders the one that shares more comes first; only if both share as many are
    they compared, from there on, and the loser then knows what it shares with the winner.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.n = 1
        while self.n < len(runs):
            self.n *= 2
        self.head = [next(r, None) for r in runs] + [None] * (self.n - len(runs))
        self.lcp = [0] * self.n
        self.node = [0] * self.n
        self.top = self._build(1)

    def _build(self, k: int) -> int:
        if k >= self.n:
            return k - self.n
        win, lose = self._play(self._build(2 * k), self._build(2 * k + 1))
        self.node[k] = lose
        return win

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser)"""
        a, b = self.head[i], self.head[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        x, y = self.lcp[i], self.lcp[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        k = shared(a[1], b[1], x)
        if a[1][k:] <= b[1][k:]:
            self.lcp[j] = k
            return i, j
        self.lcp[i] = k
        return j, i

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        """(bytes shared with the one before, record)"""
        while (item := self.head[self.top]) is not None:
            yield self.lcp[self.top], item
            i = self.top
            self.head[i] = new = next(self.runs[i], None)
            self.lcp[i] = new[0] if new else 0
            k = (i + self.n) // 2
            while k:
                i, self.node[k] = self._play(i, self.node[k])
                k //= 2
            self.top = i


def runs(found: DataFrame, cfg: SuffixConfig, dealt: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(part, run) and, for hot grams, (window, text_id, at): the suffixes to merge, the windows to count.

    dealt: ranges(). A task's suffixes of a partition are one run, or a few of them if they are many.
    """
    shared_ranges = found.sparkSession.sparkContext.broadcast(dealt)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        names = ["part", "run", "window", "text_id", "at"]
        start, width = shared_ranges.value
        by: dict[int, list] = {}
        held, done = 0, set()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def sorted_runs() -> Iterator[pa.RecordBatch]:
            for p in sorted(by):
                yield batch([(p, coded(sorted(by.pop(p), key=lambda x: x[0])), None, None, None)])

        for b in sliced(batches, 1024):
            wins: list[tuple[bytes, int, int]] = []
            for key, text, grams, hot in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                if key in done:
                    continue
                done.add(key)
                raw = text.as_py()
                want, often = (np.sort(g.values.to_numpy(zero_copy_only=False)) for g in (grams, hot))
                data = np.frombuffer(raw, np.uint8)
                for h, pos, first, last in elected(data, cfg):
                    hs = h.view(np.int64)
                    pick = np.flatnonzero(np.isin(hs, want))
                    head = heads(data, pos[pick])
                    part = (start[head] + (mix(h[pick]) % width[head].astype(np.uint64)).astype(np.int64)).tolist()
                    is_hot = np.isin(hs[pick], often).tolist()
                    for p, o, a, s, e in zip(part, is_hot, pos[pick].tolist(), first[pick].tolist(), last[pick].tolist(), strict=True):
                        if o:
                            wins += [(hashlib.blake2b(raw[w : w + cfg.length], digest_size=16).digest(), key, w) for w in range(s, e + 1)]
                        else:
                            by.setdefault(p, []).append((raw[a : e + cfg.length], raw[s:a], key, s, e - s + 1))
                            held += e + cfg.length - s
                if held > cfg.run:
                    yield from sorted_runs()
                    held = 0
            if wins:
                yield batch([(None, None, *w) for w in wins])
        yield from sorted_runs()

    cols = found.select("text_id", F.col("text").cast("binary").alias("b"), "grams", "hot")
    return cols.mapInArrow(work, "part int, run binary, window binary, text_id long, at long")


def repeated_windows(items: list[tuple[int, tuple]], cfg: SuffixConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end byte) covered by windows that have an equal among merged suffixes."""
    seen, keep, low = set(), [], cfg.length
    for k, x in items:  # a text read twice counts once
        low = min(low, k)
        if (x[3], x[4]) not in seen:
            seen.add((x[3], x[4]))
            keep.append((low, x))
            low = cfg.length
    lcp = np.array([k for k, _ in keep])
    text = np.array([x[3] for _, x in keep], np.int64)
    first = np.array([x[4] for _, x in keep], np.int64)
    before = np.array([len(x[2]) for _, x in keep])
    n = np.array([x[5] for _, x in keep])
    width = cfg.length - cfg.gram + 1
    left = np.zeros((len(keep), width - 1), np.uint8)
    for i, (_, x) in enumerate(keep):
        if x[2]:
            left[i, : len(x[2])] = np.frombuffer(x[2], np.uint8)[::-1]
    # hash of the last o bytes before the position, carried along from each o to the next
    sums, power = np.zeros(len(keep), np.uint64), np.ones(1, np.uint64)
    hit = np.zeros((len(keep), width + 1), bool)
    for o in range(width):
        if o:
            sums += mix(left[:, o - 1].astype(np.uint64) + np.uint64(1)) * power
            power *= np.uint64(0xD6E8FEB86659FD93)
        # window at distance o before the position: equal on cfg.length - o bytes after it and o before it
        mine = np.flatnonzero((before >= o) & (before - n < o))
        if len(mine) < 2:
            continue
        # numbered apart from the bytes, so that a group and a byte never stand for each other in the sum
        group = np.cumsum(lcp < cfg.length - o)[mine].astype(np.uint64) + np.uint64(1 << 40)
        key = mix(group) + sums[mine]
        _, back, count = np.unique(mix(key), return_inverse=True, return_counts=True)
        hit[mine, o] = count[back] > 1
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    i, a = np.nonzero(edge == 1)
    _, z = np.nonzero(edge == -1)
    pos = first[i] + before[i]
    return text[i], pos - (z - 1), pos - a + cfg.length


def merged(coded_runs: DataFrame, cfg: SuffixConfig) -> DataFrame:
    """(text_id, b, e): bytes covered by repeated windows, per partition of the suffixes."""

    def work(t: pa.Table) -> pa.Table:
        tree = LoserTree([decoded(x.as_py()) for x in t.column("run")])
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        items: list[tuple[int, tuple]] = []
        for k, x in tree:
            if k < cfg.gram and len(items) >= 20_000:
                for c, v in zip(out, repeated_windows(items, cfg), strict=True):
                    c.append(v)
                items = []
            items.append((k, x))
        if items:
            for c, v in zip(out, repeated_windows(items, cfg), strict=True):
                c.append(v)
        del tree, items
        release()
        return pa.table(dict(zip(("text_id", "b", "e"), map(np.concatenate, out), strict=True)))

    return coded_runs.groupBy("part").applyInArrow(work, "text_id long, b long, e long")


def cut(found: DataFrame) -> DataFrame:
    """(text_id, n_removed, n_spans, kept_sha256, kept) of texts with their intervals to remove."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in sliced(batches):
            rows = []
            for key, text, bs, es in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                raw = text.as_py()
                step = np.zeros(len(raw) + 1, np.int64)
                np.add.at(step, bs.values.to_numpy(), 1)
                np.add.at(step, es.values.to_numpy(), -1)
                gone = np.cumsum(step)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((key, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)],
                names=["text_id", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    cols = found.select("text_id", F.col("text").cast("binary").alias("t"), "bs", "es")
    return cols.mapInArrow(work, "text_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def identified(docs: DataFrame, text: Column, cfg: SuffixConfig, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(text_id, doc_id, copies) of each different text, and (doc_id, text, text_id) of all rows.

    Texts are numbered by a hash. A second hash tells whether two different texts have the same number; if any
    two have, all are numbered anew with another seed.
    """
    for seed in count():
        number = F.shiftright(F.xxhash64(F.lit(seed), text), 64 - cfg.id_bits)
        base = docs.select(F.col("doc_id").cast("long"), text.alias("text"), number.alias("text_id"))
        check = F.xxhash64(F.lit(f"check {seed}"), F.col("text"))
        copies = scratch.save(
            base.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min(check).alias("lo"), F.max(check).alias("hi"))
        )
        if copies.filter("lo <> hi").isEmpty():
            return copies.drop("lo", "hi"), base
        scratch.drop(copies)
    raise AssertionError


def remove_repeats(
    docs: DataFrame, cfg: SuffixConfig = SuffixConfig(), text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) for every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    copies, base = identified(docs, text, cfg, scratch)
    long = base.filter(F.octet_length("text") >= cfg.length)

    rows = scratch.save(gram_rows(long, cfg))
    twice = rows.groupBy("gram").agg(
        F.min("text_id").alias("lo"), F.max("text_id").alias("hi"), F.max("twice").alias("twice"), F.count(F.lit(1)).alias("n"), F.min("head").alias("head")
    )
    twice = scratch.save(twice.filter("lo <> hi or twice").select("gram", (F.col("n") > cfg.hot).alias("hot"), "n", "head"))
    # at most 2^16 rows
    weights = {r["head"]: r["n"] for r in twice.filter("not hot").groupBy("head").agg(F.sum("n").alias("n")).collect()}
    dealt = ranges(weights, parts(spark, docs))
    wanted = scratch.save(
        rows.join(twice.select("gram", "hot"), "gram").select("text_id", "gram", "hot").distinct()
        .groupBy("text_id").agg(F.collect_list("gram").alias("grams"), F.collect_list(F.when(F.col("hot"), F.col("gram"))).alias("hot"))
    )
    scratch.drop(rows)
    scratch.drop(twice)
    # of equal texts the one with the smallest doc_id stands for all
    one = copies.select("text_id", F.col("doc_id").alias("one"))
    texts = base.select("doc_id", "text_id", "text")

    def with_text(some: DataFrame) -> DataFrame:
        """some(text_id, one, …) with the texts of these documents."""
        s = some.withColumnRenamed("text_id", "_id")
        return texts.join(s, (F.col("text_id") == F.col("_id")) & F.col("doc_id").eqNullSafe(F.col("one"))).drop("_id")

    sent = scratch.save(runs(with_text(wanted.join(one, "text_id")), cfg, dealt))
    scratch.drop(wanted)
    covered = merged(sent.filter("part is not null").select("part", "run"), cfg)
    wins = sent.filter("part is null").select("window", "text_id", "at")
    again = wins.groupBy("window").agg(F.min(F.struct("text_id", "at")).alias("x"), F.max(F.struct("text_id", "at")).alias("y"))
    hot = wins.join(again.filter("x <> y").select("window"), "window")
    hot = hot.select("text_id", F.col("at").alias("b"), (F.col("at") + cfg.length).alias("e"))
    spans = scratch.save(covered.union(hot).groupBy("text_id").agg(F.collect_list("b").alias("bs"), F.collect_list("e").alias("es")))
    scratch.drop(sent)
    # texts with copies go as a whole; only the others need their bytes again
    result = cut(with_text(spans.join(one.join(copies.filter("copies = 1").select("text_id"), "text_id"), "text_id")))
    result = scratch.save(result if keep_text else result.drop("kept")).dropDuplicates(["text_id"])
    scratch.drop(spans)
    total = copies.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    known = copies.select("text_id", (F.col("copies") > 1).alias("whole")).join(result, "text_id", "left")
    common = copies.filter(F.col("copies") * COMMON > F.greatest(F.lit(total), F.lit(COMMON))).select("text_id")
    all_rows = base.select("doc_id", "text_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"), *(["text"] if keep_text else []))
    out = join_spread(all_rows, known, ["text_id"], common)
    goes = F.col("whole") & (F.col("n_bytes") >= cfg.length)
    empty = hashlib.sha256(b"").hexdigest()
    cols = [
        F.col("doc_id"),
        F.col("n_bytes"),
        F.when(goes, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(goes, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(goes, empty).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    ]
    if keep_text:
        cols.append(F.when(goes, F.lit("").cast("binary")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept_text"))
    return out.select(*cols)
