"""Repeated windows of words, found by a count-min sketch and then grouped exactly.

A window is ``words`` consecutive words of one document. It is removed, word by word, wherever
its sequence also starts in a document with a smaller doc_id.

Documents are dealt into blocks and written once, so that every later pass sees the same blocks.

1. Sketch. Every block makes its own count-min sketch of its distinct windows. The width follows
   from the bytes of the corpus, so a sketch is kept as the cells that it fills, cut by ranges
   of cells. The sketches of a range are merged by adding them up, and every block is told which of its
   cells hold two or more. A cell counts at least what each of its windows counts, so a window that
   is repeated anywhere always passes; others pass if all their cells are shared by chance.
2. Exact grouping. Each block sends the windows that pass, each once, with the least doc_id that
   it has there; they are grouped by a fingerprint of 96 bits, and a block is told the
   corpus's least doc_id where it is less than its own.
3. Each block removes what is covered.

What goes through a shuffle besides the texts are arrays with at most one entry for each distinct
window of a block, so a passage that a third of all documents share is no more in any group than the
number of blocks. Nothing is broadcast and nothing comes to the driver but the number of bytes.

Words are told apart by a 128-bit digest, windows by two sums of digests times powers modulo
2^64, finished by a mix and kept to 96 bits: two windows of different words are taken for one with a chance of about 2^-90.

Defined cases: a null or empty text has no words; texts under ``words`` words lose nothing; texts
of any length are one block's at most; windows repeated within one document only stay, and so do
those of rows with the same doc_id, as neither is smaller; a null doc_id is neither smaller nor
greater than any, so such rows neither lose nor take words; an empty table gives an empty
result; columns of the input that are called like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, release, sliced, without
from .shingles import mix, powers

ADDED = ["n_words", "n_removed", "kept"]
NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class WindowConfig:
    """words: length of a window; depth: rows of the sketch; cells: cells of a row for each byte of text;
    span: cells of a range, and windows of a group, that a task merges; block: bytes of a block of texts."""

    words: int = 50
    depth: int = 2
    cells: float = 1.0
    span: int = 1 << 24
    block: int = 8 << 20

    def width_bits(self, size: int) -> int:
        """Cells of a row of the sketch, as a power of two that grows with the corpus."""
        return min(60, max(10, int(size * self.cells).bit_length()))

    def shift(self, size: int) -> int:
        """A cell's range is the cell without so many low bits; a place in it takes three bytes."""
        return min(24, self.width_bits(size), self.span.bit_length() - 1)


class Digests:
    """Two 64-bit halves of each word's digest, by word; forgotten when there are many."""

    LIMIT = 400_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place = _Places(self)
        self.held = 0
        self.halves = bytearray()

    def of(self, words: list[bytes]) -> np.ndarray:
        """(2, n) numbers."""
        if len(self.place) > self.LIMIT or self.held > 32 << 20:
            self.clear()
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return np.frombuffer(bytes(self.halves), np.uint64).reshape(-1, 2)[at].T if words else np.empty((2, 0), np.uint64)


class _Places(dict):
    """A word's place among the digests; a new word gets the next one."""

    def __init__(self, of: Digests):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.of.held += len(word)
        self.of.halves += blake2b(word, digest_size=16).digest()
        return at


_digests = Digests()


def windows(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (2, n) of all windows of texts with these numbers of words, and how many windows each text has."""
    n = words.shape[1]
    up, down = powers.of(n + 1)
    sums = np.zeros((2, n + 1), np.uint64)
    np.cumsum(words * up[:n], axis=1, out=sums[:, 1:])
    every = mix((sums[:, k:] - sums[:, : n + 1 - k]) * down[: n + 1 - k]) if n >= k else np.empty((2, 0), np.uint64)
    many = np.maximum(counts - (k - 1), 0)
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    every[1] >>= np.uint64(32)  # 96 bits are enough, and less to send
    return every[:, at], many


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each fingerprint in a row of the sketch."""
    seed = np.uint64((0x9E3779B97F4A7C15 * (row + 1)) % 2**64)
    return mix(h ^ seed) >> np.uint64(64 - bits)


class Block:
    """The texts of a block, their words and windows."""

    def __init__(self, texts: list[bytes | None], cfg: WindowConfig):
        self.k = cfg.words
        self.words = [(t or b"").split() for t in texts]  # at the six ASCII white-space characters
        self.counts = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.h, self.many = windows(_digests.of(list(chain.from_iterable(self.words))), self.counts, self.k)

    def smallest(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows (2, m) in order, the least doc_id of each, and which of them each window is."""
        order = np.argsort(self.h[0], kind="stable")
        a, b = self.h[0][order], self.h[1][order]
        same = np.flatnonzero(a[1:] == a[:-1])
        if len(same) and (b[same] != b[same + 1]).any():
            order = np.lexsort((self.h[1], self.h[0]))
            a, b = self.h[0][order], self.h[1][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        of = np.empty(len(a), np.int64)
        of[order] = np.cumsum(new) - 1
        doc = np.repeat(ids, self.many)[order]
        return np.stack([a[first], b[first]]), np.minimum.reduceat(doc, first) if len(first) else doc, of

    def covered(self, window: np.ndarray) -> list[np.ndarray]:
        """For each text which of its words the marked windows cover."""
        out, at = [], 0
        for n, m in zip(self.counts.tolist(), self.many.tolist(), strict=True):
            edge = np.zeros(n + 1, np.int64)
            if m:
                hit = window[at : at + m]
                edge[:m] += hit
                edge[self.k : self.k + m] -= hit
            out.append(np.cumsum(edge[:n]) > 0)
            at += m
        return out


def _number(docs: DataFrame, cfg: WindowConfig) -> DataFrame:
    """The rows with the block each belongs to: about ``cfg.block`` bytes of one partition."""
    block = cfg.block

    @F.arrow_udf("long")
    def place(sizes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, at = 0, TaskContext.get().partitionId() << 32
        for batch in sizes:
            out = []
            for n in batch.to_pylist():
                if held and held + n > block:
                    held, at = 0, at + 1
                held += n
                out.append(at)
            yield pa.array(out, pa.int64())

    return docs.withColumn("_block", place.asNondeterministic()(F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long") + 64))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """(block, ids, texts) of neighbouring rows of a block."""
    block, ids, texts = None, [], []
    for b in sliced(batches, 256):
        for at, i, t in zip(b.column("_block").to_pylist(), b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
            if at != block:
                if ids:
                    yield block, ids, texts
                block, ids, texts = at, [], []
            ids.append(NONE if i is None else i)
            texts.append(None if i is None else t)
    if ids:
        yield block, ids, texts


def _packed(cells: np.ndarray) -> bytes:
    """Numbers under 2^24 in three bytes each."""
    return np.ascontiguousarray(cells.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _cells(x: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 3).astype(np.int64)
    return raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16


def _split(keys: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """(range, where) of sorted numbers, by what is left without their low bits."""
    part = keys >> np.uint64(shift)
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        if j > i:
            yield int(part[i]), slice(i, j)


def sketch(rows: DataFrame, cfg: WindowConfig, size: int) -> DataFrame:
    """(row, part, _block, once, more): the cells of a block's sketch in a range, those with one window and those with several."""
    bits, shift = cfg.width_bits(size), cfg.shift(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << shift) - 1)
        for block, _, texts in _grouped(batches):
            out: list[list] = [[], [], [], [], []]
            h = np.unique(Block(texts, cfg).h[0])
            for r in range(cfg.depth):
                c, n = np.unique(cells(h, r, bits), return_counts=True)
                for part, where in _split(c, shift):
                    at, many = c[where] & low, n[where] > 1
                    for o, v in zip(out, (r, part, block, _packed(at[~many]), _packed(at[many])), strict=True):
                        o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["row", "part", "_block", "once", "more"])
            release()

    return rows.select("_block", "_id", "_text").mapInArrow(run, "row int, part long, _block long, once binary, more binary")


def merged(sketches: DataFrame, cfg: WindowConfig, size: int) -> DataFrame:
    """(_block, row, part, cells): those cells of a block that count two or more in the sum of all sketches."""
    width = 1 << cfg.shift(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(width, np.uint8)  # 0, 1 or 2, which is two or more
        held = []
        for b in batches:
            held.append(b)
            for name, step in (("once", 1), ("more", 2)):
                for x in b.column(name):
                    at = _cells(x)
                    count[at] = np.minimum(count[at] + step, 2)
        for b in held:
            out = []
            for once, more in zip(b.column("once"), b.column("more"), strict=True):
                at = _cells(once)
                out.append(_packed(np.sort(np.concatenate([at[count[at] > 1], _cells(more)]))))
            yield pa.RecordBatch.from_arrays([b.column("_block"), b.column("row"), b.column("part"), pa.array(out, pa.binary())], names=["_block", "row", "part", "cells"])
        release()

    return sketches.groupBy("row", "part").applyInArrow(run, "_block long, row int, part long, cells binary").where(F.length("cells") > 0)


def _wide(b: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in b.column(name)]


def candidates(rows: DataFrame, hot: DataFrame, cfg: WindowConfig, size: int) -> DataFrame:
    """(part, _block, h1, h2, least): the windows of a block that the sketch holds for repeated, with the block's least doc_id."""
    bits, shift = cfg.width_bits(size), cfg.shift(size)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = [NONE if i is None else i for i in left.column("_id").to_pylist()], left.column("_text").to_pylist()
        h, least, _ = Block([None if i == NONE else t for i, t in zip(ids, texts, strict=True)], cfg).smallest(np.array(ids, np.int64))
        keep = np.ones(h.shape[1], bool)
        for r in range(cfg.depth):
            mine = right.filter(pc.equal(right.column("row"), r))
            parts = [((p << shift) + _cells(c)).astype(np.uint64) for p, c in zip(mine.column("part").to_pylist(), mine.column("cells"), strict=True)]
            passed = np.sort(np.concatenate([*parts, np.empty(0, np.uint64)]))
            c = cells(h[0], r, bits)
            at = np.minimum(np.searchsorted(passed, c), max(0, len(passed) - 1))
            keep &= passed[at] == c if len(passed) else False
        h, least = h[:, keep], least[keep]
        cols: list[list] = [[], [], [], [], []]
        for part, where in _split(h[0], 64 - bits + shift):
            for o, v in zip(cols, (part, key[0].as_py(), h[0][where].tobytes(), h[1][where].astype("<u4").tobytes(), least[where].tobytes()), strict=True):
                o.append(v)
        release()
        return pa.table([pa.array(o, t) for o, t in zip(cols, (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], names=["part", "_block", "h1", "h2", "least"])

    schema = "part long, _block long, h1 binary, h2 binary, least binary"
    return rows.select("_block", "_id", "_text").groupBy("_block").cogroup(hot.groupBy("_block")).applyInArrow(run, schema)


def grouped(found: DataFrame) -> DataFrame:
    """(_block, h1, h2, least): windows of a block whose least doc_id in the corpus is less than in the block."""

    def run(t: pa.Table) -> pa.Table:
        a, b, least = (_wide(t, c, k) for c, k in (("h1", "<u8"), ("h2", "<u4"), ("least", "<i8")))
        n = np.array([len(x) for x in a])
        a, b, least = map(np.concatenate, (a, b, least))
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        all_least = np.empty(len(a), np.int64)
        first = np.flatnonzero(new)
        all_least[order] = np.minimum.reduceat(least[order], first)[np.cumsum(new) - 1]
        cols: list[list] = [[], [], [], []]
        for block, end, m in zip(t.column("_block").to_pylist(), np.cumsum(n).tolist(), n.tolist(), strict=True):
            part = slice(end - m, end)
            less = all_least[part] < least[part]
            if less.any():
                for o, v in zip(cols, (block, *[x[part][less].tobytes() for x in (a, b, all_least)]), strict=True):
                    o.append(v)
        release()
        return pa.table([pa.array(o, x) for o, x in zip(cols, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["_block", "h1", "h2", "least"])

    return found.groupBy("part").applyInArrow(run, "_block long, h1 binary, h2 binary, least binary")


def _cleaned(rows: DataFrame, less: DataFrame, cfg: WindowConfig, carried: list[str]) -> DataFrame:
    """The ``carried`` columns, n_words, n_removed and kept of every row."""
    schema = StructType([*[rows.schema[c] for c in carried], *StructType.fromDDL("n_words long, n_removed long, kept binary").fields])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.array([NONE if i is None else i for i in left.column("_id").to_pylist()], np.int64)
        block = Block(left.column("_text").to_pylist(), cfg)
        h, least, of = block.smallest(ids)
        if right.num_rows and h.shape[1]:
            a, b, other = (np.concatenate(_wide(right, c, k)) for c, k in (("h1", "<u8"), ("h2", "<u4"), ("least", "<i8")))
            order = np.lexsort((b, a))
            a, b, other = a[order], b[order], other[order]
            at = np.searchsorted(h[0], a)
            while (wrong := (h[1][at] != b) | (h[0][at] != a)).any():  # equal first halves stand side by side
                at[wrong] += 1
            least[at] = np.minimum(least[at], other)
        doc = np.repeat(ids, block.many)
        gone = block.covered((least[of] < doc) & (doc != NONE))
        kept = [b" ".join(compress(w, (~g).tolist())) if g.any() else b" ".join(w) for w, g in zip(block.words, gone, strict=True)]
        release()
        made = [pa.array(block.counts), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(kept, pa.binary())]
        return pa.table([*[left.column(c) for c in carried], *made], names=[*carried, *ADDED])

    return rows.groupBy("_block").cogroup(less.groupBy("_block")).applyInArrow(run, schema)


def remove_windows(docs: DataFrame, cfg: WindowConfig = WindowConfig(), key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs in ``keep`` and n_words, n_removed (long) and kept: the words that stay, joined by one space.

    keep: all columns but those called like an added one, unless given. The text is written and shuffled once, kept or not.
    """
    docs = without(docs, ADDED)
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession)
    others = [c for c in docs.columns if c != text and (c in keep or c == key)]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]).alias("_in")
    rows = docs.select(packed, F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("binary").alias("_text"))
    rows = scratch.save(_number(rows, cfg))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    hot = scratch.save(merged(sketch(rows, cfg, size), cfg, size))
    less = scratch.save(grouped(candidates(rows, hot, cfg, size)))
    scratch.drop(hot)
    out = _cleaned(rows, less, cfg, ["_in", "_text"] if text in keep else ["_in"])
    whole = F.col("_text").cast(docs.schema[text].dataType)
    return out.select(*[whole.alias(c) if c == text else F.col("_in")[c].alias(c) for c in keep], "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
