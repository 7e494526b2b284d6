"""Best-fit packing by bin completion.

Texts are tokenised in parallel, word by word with a cache, and cut into pieces.
Packing needs only how many pieces there are of each length, a table of at most
``size`` rows at any corpus size. On that histogram the driver runs bin
completion: the largest remaining piece opens a sequence, the undominated
fillings of the room left beside it are tried in order of their waste, and a
branch is cut where its waste or its lower bound cannot beat the best plan yet.
Plain best-fit decreasing, or least waste by sequence, is the first plan. A filling is applied to as many
sequences at once as the counts allow, or to one. The search between sequences
ends after ``nodes`` steps. Pieces then take the places of their length by rank; ranks
come from counts per partition, so a length that a third of all pieces share is
dealt out like any other.

Defined cases: a null or empty text is the single end token; an empty table gives
an empty result; repeated rows are packed as rows of their own; a null doc_id is
carried along; pieces of one length, ties, are dealt by row; other columns of
the input are ignored. Texts are never cut short: only longer documents are cut
into pieces.
"""

from __future__ import annotations

import logging
import string
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sliced
from .shingles import word_bounds, word_hashes

log = logging.getLogger(__name__)
PIECES = "row_id long, doc_id long, piece int, start long, length int, ids_crc32 long"


@dataclass(frozen=True)
class PackConfig:
    """size: tokens in a sequence; end_id: ends every document; nodes: search steps for one sequence of the
    first plan, and between sequences beyond it."""

    size: int = 2048
    end_id: int = 0
    nodes: int = 2000


def simple(letters: str) -> bool:
    """Latin letters that stay letters under NFC and lower-casing."""
    return max(letters) < "\u0250" and "\u0130" not in letters and unicodedata.is_normalized("NFC", letters)


class WordTable:
    """Token ids of each word seen, by the word's 64-bit hash.

    The tokenizer never joins across white space, so a text's ids are those of its
    words. Missing words are encoded many at a time: a run of letters is one unit to
    the tokenizer whatever ASCII punctuation follows it, and ASCII letters are
    lower-cased by it, so words are reduced to such units first.
    """

    LIMIT = 1_200_000
    CHUNK = 2000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.flat = np.empty(1 << 16, "<u4")
        self.used = 0
        self.tables = [self._table(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32))] * 2

    @staticmethod
    def _table(h: np.ndarray, off: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(h)
        return h[order], off[order].astype(np.uint32), n[order].astype(np.uint32)

    def whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        units: dict[str, list[int]] = {}
        split = []
        for w in words:
            core = w.rstrip(string.punctuation)
            if core.isalpha() and len(core) <= 60 and (core.isascii() or simple(core)):
                low, tail = core.lower() if core.isascii() else core, w[len(core) :]
                units[low] = []
                if tail and tail not in units:
                    units[tail] = self.whole(tail)
                split.append((low, tail))
            else:
                units.setdefault(w, []) or units.__setitem__(w, self.whole(w))
                split.append((w, ""))
        todo = [u for u, ids in units.items() if not ids]
        for k in range(0, len(todo), self.CHUNK):
            part = todo[k : k + self.CHUNK]
            out = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            unit = np.asarray(out.word_ids, dtype=np.int64)
            if len(unit) and unit[-1] + 1 == len(part):
                cuts, ids = np.searchsorted(unit, np.arange(len(part) + 1)).tolist(), out.ids
                for w, i, j in zip(part, cuts[:-1], cuts[1:], strict=True):
                    units[w] = ids[i:j]
            else:  # some unit was not one word to the tokenizer
                for w in part:
                    units[w] = self.whole(w)
        return [units[low] + units[tail] if tail else units[low] for low, tail in split]

    def find(self, h: np.ndarray, word_at) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids in ``flat`` for each hash of h (sorted, distinct)."""
        if len(self.tables[0][0]) > self.LIMIT or self.used >= 1 << 31:
            self.clear()
        off, n = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        for th, toff, tn in self.tables:
            if len(th):
                at = np.minimum(np.searchsorted(th, h), len(th) - 1)
                hit = np.flatnonzero(th[at] == h)
                off[hit], n[hit] = toff[at[hit]], tn[at[hit]]
        new = np.flatnonzero(n < 0)
        if len(new):
            for k in range(0, len(new), 8 * self.CHUNK):  # bounds what is held as Python objects
                part = new[k : k + 8 * self.CHUNK]
                ids = self.encode([word_at(i) for i in part.tolist()])
                n[part] = np.fromiter(map(len, ids), np.int64, len(ids))
                off[part] = self.used + np.cumsum(n[part]) - n[part]
                self.put(np.fromiter((x for w in ids for x in w), np.uint32))
            big, small = self.tables
            small = self._table(*(np.concatenate(x) for x in zip(small, (h[new], off[new], n[new]), strict=True)))
            if len(small[0]) * 8 > len(big[0]):
                big = self._table(*(np.concatenate(x) for x in zip(big, small, strict=True)))
                small = tuple(x[:0] for x in small)
            self.tables = [big, small]
        return off, n

    def put(self, ids: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(max(need, len(self.flat) * 3 // 2) - self.used, "<u4")))
        self.flat[self.used : need] = ids
        self.used = need


_tables: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """The word table of this Python process, kept from task to task."""
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def encode_texts(texts: pa.Array, words: WordTable, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """Token ids of each text (a string array without nulls)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        # texts lie side by side without white space between them, so each is set off by one
        ends = offsets[at + 1 : to + 1] - offsets[at] + np.arange(1, to - at + 1)
        buf = np.full(int(ends[-1]), 32, np.uint8)
        keep = np.ones(len(buf), bool)
        keep[ends - 1] = False
        buf[keep] = data[offsets[at] : offsets[to]]
        h, start = word_hashes(buf, lower=False)
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        _, stop = word_bounds(buf)
        raw = buf.tobytes()
        word_at = lambda i: raw[start[first[i]] : stop[first[i]]].decode()  # noqa: B023, E731
        off, n = words.find(uniq, word_at)
        off, n = off[back], n[back]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        ids = words.flat[np.repeat(off - total[:-1], n) + np.arange(total[-1])]
        cut = total[np.searchsorted(start, ends)]
        for i, j in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):
            yield ids[i:j]
        at = to


def tokenised(docs: DataFrame, tokenizer: str, cfg: PackConfig, text_col: str = "text") -> DataFrame:
    """One row for each piece of each document (PIECES)."""
    end, width = np.uint32(cfg.end_id).tobytes(), cfg.size * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(tokenizer)
        for b in sliced(batches, 2048):
            cols: list[list[Any]] = [[], [], [], [], [], []]
            row_ids, docs = (b.column(i).to_pylist() for i in range(2))
            for row, doc, ids in zip(row_ids, docs, encode_texts(b.column(2), words), strict=True):
                data = ids.tobytes() + end
                for k, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    for c, v in zip(cols, (row, doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                names=["row_id", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, PIECES)


class Histogram:
    """Counts of lengths 1..size with quick access to the largest length that fits and is left."""

    def __init__(self, counts: dict[int, int], size: int):
        self.n = [0] * (size + 1)
        for k, v in counts.items():
            self.n[k] = v
        self.below = list(range(size + 1))  # path-compressed links to the next length that is left

    def fit(self, room: int) -> int:
        """The largest length left that is at most room, or 0."""
        seen = []
        while room and not self.n[room]:
            seen.append(room)
            room = self.below[room] if self.below[room] < room else room - 1
        for x in seen:
            self.below[x] = room
        return room


def best_fill(h: Histogram, room: int, taken: dict[int, int]) -> list[int]:
    """The best-fit filling: always the largest piece that still fits."""
    out: list[int] = []
    while room and (x := h.fit(room)):
        have = h.n[x] - taken.get(x, 0)
        while have <= 0:
            x = h.fit(x - 1) if x > 1 else 0
            if not x:
                return out
            have = h.n[x] - taken.get(x, 0)
        k = min(have, room // x)
        out += [x] * k
        taken[x] = taken.get(x, 0) + k
        room -= k * x
    return out


def completion(h: Histogram, room: int, nodes: int) -> list[int]:
    """The filling of room that wastes least, of those seen within so many nodes.

    A quick one for the first whole plans; ``fillings`` has no limit.

    Depth first over lengths in falling order, taking a length before leaving it
    out. A filling that leaves out a length which would still fit is dominated, so
    once a length is left out the waste must end below it. A branch ends where its
    waste bound cannot beat the incumbent, which is the best-fit filling at first.
    """
    best = best_fill(h, room, {})
    sums = list(accumulate(k * v for k, v in enumerate(h.n)))
    waste, left = room - sum(best), nodes
    taken: list[int] = []
    used: dict[int, int] = {}
    todo: list[tuple[int, int, int] | None] = [(room, room, room + 1)]  # None: give the last piece back
    while todo and waste and left >= 0:
        step = todo.pop()
        if step is None:
            used[taken.pop()] -= 1
            continue
        room, top, bound = step
        x = h.fit(min(top, room))
        while x and used.get(x, 0) >= h.n[x]:
            x = h.fit(x - 1) if x > 1 else 0
        if not x:
            if room < min(waste, bound):
                best, waste = list(taken), room
            continue
        # all pieces of x and shorter together, less those taken of x, must bring the waste low enough
        if room - (sums[x] - x * used.get(x, 0)) >= min(waste, bound):
            continue
        left -= 1
        # leaving x out: all shorter pieces together must still fill room to below x
        if x > 1:
            todo.append((room, x - 1, min(bound, x)))
        todo.append(None)
        todo.append((room - x, x, bound))
        taken.append(x)
        used[x] = used.get(x, 0) + 1
    return best


def fillings(h: Histogram, room: int, top: int) -> Iterator[list[int] | None]:
    """The undominated fillings of room with lengths of at most top, least waste first, then longest pieces first.

    A branch is entered only if the shorter lengths can bring its sum to just the waste aimed at, by the sums
    that they reach (one bit each), so the first filling wastes least. None stands for a filling that leaves
    room for a length it leaves out: it is dominated.
    """
    lens = [x for x in range(min(room, top), 0, -1) if h.n[x]]
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in reversed(lens):
        r, left, k = reach[-1], min(h.n[x], room // x), 1
        while left:
            r |= (r << min(k, left) * x) & mask
            left, k = left - min(k, left), 2 * k
        reach.append(r)
    reach.reverse()  # reach[i]: sums of lens[i:]

    def rest(i: int, want: int) -> Iterator[list[int]]:
        if not want:
            yield []
            return
        for j in range(i, len(lens)):
            if not reach[j] >> want & 1:
                return
            x = lens[j]
            for c in range(min(h.n[x], want // x), 0, -1):
                if reach[j + 1] >> (want - c * x) & 1:
                    for more in rest(j + 1, want - c * x):
                        yield [x] * c + more

    for want in range(room, -1, -1):
        if reach[0] >> want & 1:
            for out in rest(0, want):
                fits = (x for x in lens if x <= room - want)
                yield None if any(out.count(x) < h.n[x] for x in fits) else out


def bound_below(n: list[int], size: int) -> int:
    """Sequences that pieces n[length] need at least: by their sum, and one for each of over half a sequence."""
    return max(-(-sum(k * v for k, v in enumerate(n)) // size), sum(n[size // 2 + 1 :]))


def plan(counts: dict[int, int], size: int, nodes: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence in order, how many such sequences), for all pieces.

    Depth first over the fillings beside the largest piece left, each as often as the counts allow and then
    once. A branch ends where its sequences and the lower bound for what is left cannot beat the best plan
    yet; the search ends at the lower bound, or after ``nodes`` steps beyond the first whole plan.
    """

    def build(fill) -> list[tuple[list[int], int]]:
        h, out = Histogram(counts, size), []
        top = h.fit(size)
        while top:
            h.n[top] -= 1
            shape = [top, *fill(h, size - top)]
            h.n[top] += 1
            out.append((shape, _apply(h, shape)))
            top = h.fit(top)
        return out

    least = bound_below(Histogram(counts, size).n, size)
    best = build(lambda h, room: best_fill(h, room, {}))
    used = sum(t for _, t in best)
    if used > least:
        second = build(lambda h, room: completion(h, room, nodes))
        if sum(t for _, t in second) < used:
            best, used = second, sum(t for _, t in second)

    h = Histogram(counts, size)
    now: list[tuple[list[int], int]] = []
    stack: list[Iterator[tuple[list[int], int] | None]] = [_choices(h, size)]
    total, whole = 0, False
    while stack and used > least and nodes > 0:
        nodes -= whole
        if len(now) == len(stack):  # undo what this level tried before
            shape, times = now.pop()
            total -= times
            for x in shape:
                h.n[x] += times
        choice = next(stack[-1], ())
        if choice == ():
            stack.pop()
            continue
        if choice is None:
            continue
        shape, times = choice
        now.append(choice)
        total += times
        for x in shape:
            h.n[x] -= times
        if not any(h.n):
            whole = True
            if total < used:
                best, used = list(now), total
        elif total + bound_below(h.n, size) < used:
            stack.append(_choices(h, size))
        else:
            whole = True  # cut: as far as this plan goes
    if used > least and stack:
        log.info("the search ended after its steps: %d sequences, at least %d are needed", used, least)
    return best


def _apply(h: Histogram, shape: list[int]) -> int:
    """Take shape from h as often as it goes."""
    times = min(h.n[x] // shape.count(x) for x in set(shape))
    for x in shape:
        h.n[x] -= times
    return times


def _choices(h: Histogram, size: int) -> Iterator[tuple[list[int], int] | None]:
    """Sequences with the largest length of h, as often as they go and once; h is as now whenever one is asked for."""
    top = max(x for x in range(size + 1) if h.n[x])
    h.n[top] -= 1
    ways = fillings(h, size - top, top)
    while True:
        fill = next(ways, ())
        h.n[top] += 1
        if fill == ():
            return
        if fill is None:
            yield None
        else:
            shape = [top, *fill]
            times = min(h.n[x] // shape.count(x) for x in set(shape))
            yield shape, times
            if times > 1:
                yield shape, 1
        h.n[top] -= 1


def places(shapes: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, its blocks of ranks: first rank, first sequence, pieces of it in a sequence, offsets of these."""
    out: dict[int, list[tuple[int, int, list[int]]]] = {}
    rank: dict[int, int] = {}
    first = 0
    for shape, times in shapes:
        at, offsets = 0, {}
        for x in shape:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, offs in offsets.items():
            out.setdefault(x, []).append((rank.get(x, 0), first, offs))
            rank[x] = rank.get(x, 0) + len(offs) * times
        first += times
    return {
        x: (np.array([b[0] for b in bs]), np.array([b[1] for b in bs]), [np.array(b[2]) for b in bs]) for x, bs in out.items()
    }


def pack(docs: DataFrame, tokenizer: str, cfg: PackConfig = PackConfig(), text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    pieces = Scratch(spark).save(tokenised(docs, tokenizer, cfg, text_col).withColumn("part", F.spark_partition_id()))
    # how many pieces of each length each part holds, and the ranks that lie before them
    held = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shapes = spark.sparkContext.broadcast(places(plan(counts, cfg.size, cfg.nodes)))
    before = held.select("part", "length", _before("n").alias("before"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shapes.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for idx in np.split(order, cuts):
                if not len(idx):
                    continue
                first, base, offs = blocks[int(length[idx[0]])]
                which = np.searchsorted(first, rank[idx], "right") - 1
                for k in np.unique(which):
                    i = idx[which == k]
                    r = rank[i] - first[k]
                    seq[i], off[i] = base[k] + r // len(offs[k]), offs[k][r % len(offs[k])]
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in ("doc_id", "piece", "start")]
                + [b.column("length").cast(pa.int64()), b.column("ids_crc32"), pa.array(seq), pa.array(off)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = _ranked(pieces, before)
    return ranked.mapInArrow(
        put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def _before(n: str):
    """Running count of earlier parts of the same length."""
    from pyspark.sql import Window

    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(w), F.lit(0))


def _ranked(pieces: DataFrame, before: DataFrame) -> DataFrame:
    """pieces with their rank among all of the same length."""
    from pyspark.sql import Window

    w = Window.partitionBy("part", "length").orderBy("row_id", "piece")
    inside = pieces.withColumn("inside", F.row_number().over(w) - 1)
    return inside.join(before, ["part", "length"]).withColumn("rank", (F.col("before") + F.col("inside")).cast("long"))
