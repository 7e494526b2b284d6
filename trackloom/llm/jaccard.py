"""Exact n-gram Jaccard join as a metric-space join.

Sets of word shingles under Jaccard distance. The pivots are single shingles: a set
is at distance 1 - 1/n from each pivot it holds and at distance 1 from all others, so
a set belongs to the Voronoi region of the first of its shingles in a global order
that settles the ties. The triangle inequality bounds which other regions may hold a
partner within distance t: with n members, only those of the first n - ceil((1-t) n) + 1
pivots in that order. Boundary sets are replicated to just these regions. The order
puts shingles that many sets share behind all others (a fixed-size count sketch tells
which they are), so regions of the first kind are small and are joined directly.

Regions of widely shared shingles are joined recursively: a whole set is taken as the
region's pivot, its distance to every member is computed, members within t of it fall
into one component and need no comparison among themselves, and of the others only
pairs are compared whose distances to the pivot differ by at most t. All comparisons
are verified on the whole sets.

Documents as pivots from the start would not do: nearly all pairs of texts are at
distance 1, where the triangle inequality excludes nothing.

Copies are one set. Sets are numbered by a digest and numbered anew if a second digest
tells that two share a number; shingles are told apart by 64-bit hashes. Defined cases:
null, empty and blank texts have an empty set, linked with
nothing; a text shorter than a shingle has the whole word sequence as its one shingle;
repeated rows and copies share a component; a null doc_id is a document of its own that
names its component only if no other does; texts of any length give their whole set; an
empty table gives an empty result; other columns of the input, whatever their names, are
ignored, and drop_near_copies keeps them all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import COMMON, Scratch, join_spread, packed_up, parts, sliced, unpacked
from .graph import components
from .shingles import shingle_sets

CHUNKS = 64


@dataclass(frozen=True)
class JaccardConfig:
    """k: words in a shingle; percent: least similarity; bits: width of the count sketch, 0 for one that fits the texts.

    spread: standard deviations above the mean load that make a sketch cell heavy;
    rounds: pivots tried in a region of heavy shingles before its rest is compared pairwise;
    id_bits: width of the sets' numbers, less only in tests.
    """

    k: int = 5
    percent: int = 80
    bits: int = 0
    spread: float = 8.0
    rounds: int = 3
    id_bits: int = 64
    seed: int = 0


def sketch_bits(docs: DataFrame, text_col: str) -> int:
    """A cell of the sketch for about every 160 bytes of text, so some twenty shingles each; at most 2^24 cells.

    A cell counts as heavy from 8 standard deviations above the mean, so beyond 2^24 cells a light region may hold
    some multiple of the root of the mean: 13,000 sets at 10^13 shingles.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return min(24, max(16, (size // 160).bit_length()))


def _blocks(b: pa.RecordBatch, cfg: JaccardConfig) -> Iterator[tuple[int, np.ndarray, int]]:
    """(doc_id, sorted set, number of the set) of each row."""
    for doc, s, number, _ in _checked_blocks(b, cfg):
        yield doc, s, number


def _checked_blocks(b: pa.RecordBatch, cfg: JaccardConfig) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(doc_id, sorted set, number of the set, second digest) of each row."""
    texts = b.column(1).to_pylist()
    for doc, s in zip(b.column(0).to_pylist(), shingle_sets(texts, cfg.k), strict=True):
        d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=cfg.seed.to_bytes(4, "little")).digest()
        number, check = (int.from_bytes(x, "little", signed=True) for x in (d[:8], d[8:]))
        yield doc, s, number >> (64 - cfg.id_bits), check


def signatures(docs: DataFrame, cfg: JaccardConfig, text_col: str) -> DataFrame:
    """Rows (doc_id, n, set_id, check) for the documents and (chunk, task, counts) for the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cell, seen, task = np.zeros(1 << cfg.bits, np.uint32), set(), TaskContext.get().partitionId()
        names = ["doc_id", "n", "set_id", "check", "chunk", "task", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for b in sliced(batches):
            rows, hashes = [], []
            for doc, s, digest, check in _checked_blocks(b, cfg):
                rows.append((doc, len(s), digest, check))
                if digest not in seen:
                    seen.add(digest)
                    hashes.append(s)
            if hashes:
                at, n = np.unique(np.concatenate(hashes) >> np.uint64(64 - cfg.bits), return_counts=True)
                cell[at.astype(np.int64)] += n.astype(np.uint32)
            cols = [*zip(*rows, strict=True)] if rows else [(), (), (), ()]
            nothing = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, nothing, nothing, nothing], kinds, strict=True)], names=names)
        if seen:
            parts_ = [zlib.compress(x.tobytes(), 1) for x in np.split(cell, CHUNKS)]
            cols = [[None] * CHUNKS] * 4 + [list(range(CHUNKS)), [task] * CHUNKS, parts_]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_col).mapInArrow(
        run, "doc_id long, n long, set_id long, check long, chunk int, task int, counts binary"
    )


def heavy_cells(sketches: DataFrame, cfg: JaccardConfig) -> np.ndarray:
    """Bit set over the sketch's cells: those with far more than the mean load. 2^bits bits at any corpus size."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros((1 << cfg.bits) // CHUNKS, np.uint32)
        for x in t.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        return pa.table({"chunk": t.column("chunk")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    one = sketches.select("chunk", "counts", F.floor(F.col("task") / 256).alias("g"))
    summed = one.groupBy("chunk", "g").applyInArrow(add, "chunk int, counts binary")
    summed = summed.groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    cell = np.zeros(1 << cfg.bits, np.uint32)
    width = len(cell) // CHUNKS
    for r in summed.collect():  # CHUNKS rows
        cell[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    mean = float(cell.mean())
    return np.packbits(cell > mean + cfg.spread * mean**0.5 + 16)


def needed(n, cfg: JaccardConfig):
    """ceil(percent/100 * n)."""
    return -(-cfg.percent * n // 100)


def entries(docs: DataFrame, heavy: np.ndarray, cfg: JaccardConfig, text_col: str) -> DataFrame:
    """(s, set_id, n, i, hx, h, heavy): the regions that each distinct set goes to.

    hx counts the shared shingles among its pivots, h those in the whole set.
    """
    bits = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, seen = np.unpackbits(bits.value).astype(bool), set()
        for b in sliced(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            for _, s, digest in _blocks(b, cfg):
                n = len(s)
                if not n or digest in seen:
                    continue
                seen.add(digest)
                p = n - needed(n, cfg) + 1
                often = shared[(s >> np.uint64(64 - cfg.bits)).astype(np.int64)]
                light = s[~often][:p]
                mine = np.concatenate((light, s[often][: p - len(light)]))
                h = int(often.sum())
                full = np.full(p, 1, np.int64)
                hx = p - len(light)
                for c, v in zip(out, (mine.view(np.int64), full * digest, full * n, np.arange(p), full * hx, full * h, np.arange(p) >= len(light)), strict=True):
                    c.append(v)
            if out[0]:
                s_, d_, *small, h_ = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s_), pa.array(d_), *(pa.array(x.astype(np.int32)) for x in small), pa.array(h_)],
                    names=["s", "set_id", "n", "i", "hx", "h", "heavy"],
                )

    return docs.select(F.col("doc_id").cast("long"), text_col).mapInArrow(
        run, "s long, set_id long, n int, i int, hx int, h int, heavy boolean"
    )


def least_common(na: str, nb: str, cfg: JaccardConfig):
    """The smallest intersection that links sets of these sizes."""
    return F.ceil(F.lit(cfg.percent / (100 + cfg.percent)) * (F.col(na) + F.col(nb)) - 1e-6)


def light_pairs(light: DataFrame, cfg: JaccardConfig, n_parts: int) -> DataFrame:
    """Candidate pairs (a, b, na, nb) of the small regions that pass the exact bounds on overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "set_id", "n", "i", "hx"]
        rest = None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in names]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            # the last region may go on in the next batch
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            rest = [c[cut:] for c in cols]
            yield from within([c[:cut] for c in cols])
        if rest is not None:
            yield from within(rest)

    def within(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # a set that several tasks have read is one member
        own = np.ones(len(cols[0]), bool)
        own[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        s, d, n, i, hx = (c[own] for c in cols)
        left = np.flatnonzero(s[1:] == s[:-1])
        step = 1
        while len(left):
            x, y = left, left + step
            swap = d[x] > d[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            lo, hi = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
            ok = (100 * lo >= cfg.percent * hi) & (d[x] != d[y])
            x, y = x[ok], y[ok]
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (d[x], d[y], n[x], n[y], i[x], i[y], np.minimum(hx[x], hx[y]))],
                    names=["a", "b", "na", "nb", "ia", "ib", "hx"],
                )
            step += 1
            left = left[left + step < len(s)]
            left = left[s[left] == s[left + step]]

    met = (
        light.select("s", "set_id", "n", "i", "hx").repartition(n_parts, "s")
        .sortWithinPartitions("s", "set_id")
        .mapInArrow(run, "a long, b long, na int, nb int, ia int, ib int, hx int")
        .groupBy("a", "b")
        .agg(
            F.first("na").alias("na"), F.first("nb").alias("nb"), F.min("ia").alias("ia"), F.min("ib").alias("ib"),
            F.first("hx").alias("hx"), F.count(F.lit(1)).alias("c"),
        )
    )
    low = least_common("na", "nb", cfg)
    first = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    # what both hold beyond the shorter-reaching prefix is at most the longer of the two remainders
    rest = F.greatest(*[F.ceil(cfg.percent * F.col(x) / 100) - 1 for x in ("na", "nb")])
    return met.filter((first >= low) & (F.col("c") + F.col("hx") + rest >= low)).select("a", "b", "na", "nb")


def candidate_sets(docs: DataFrame, members: DataFrame, cfg: JaccardConfig, text_col: str, scratch: Scratch) -> DataFrame:
    """(set_id, set): the whole sets of members(x), as sorted 64-bit hashes.

    They are marked in a bit set with sixteen bits for each of them, 2^20 to 2^29 in all; other sets that share
    a bit go along. Far beyond 2^29 most sets do, which costs their shuffle but loses none.
    """
    asked = members.agg(F.count(F.lit(1))).first()[0]
    width = min(29, max(20, (16 * asked).bit_length()))
    ids = members.select(F.pmod("x", F.lit(1 << width)).alias("x"))
    words = ids.groupBy(F.floor(F.col("x") / 32).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(x % 32 as int))")).alias("bits")
    )
    marks = np.zeros(1 << (width - 5), np.uint32)
    got = words.toPandas()  # at most one row per member, and 2^24 of 12 bytes
    marks[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, seen = shared.value, set()
        for b in sliced(batches):
            for _, s, digest in _blocks(b, cfg):
                x = digest % (1 << width)
                if len(s) and digest not in seen and int(mark[x >> 5]) >> (x & 31) & 1:
                    seen.add(digest)
                    yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([s.tobytes()], pa.binary())], names=["set_id", "set"])

    found = docs.select(F.col("doc_id").cast("long"), text_col).mapInArrow(run, "set_id long, set binary")
    return scratch.save(found.groupBy("set_id").agg(F.first("set").alias("set")))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, common): the exact size of each pair's intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("sa"), b.column("sb")
            common = [
                len(np.intersect1d(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), assume_unique=True))
                for p, q in zip(x, y, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("a", "b", "na", "nb")), pa.array(common, pa.int32())], names=["a", "b", "na", "nb", "common"]
            )

    both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("set").alias("sa")), "a").join(
        sets.select(F.col("set_id").alias("b"), F.col("set").alias("sb")), "b"
    )
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, na int, nb int, common int")


def links_of(checked: DataFrame, cfg: JaccardConfig) -> DataFrame:
    union = F.col("na") + F.col("nb") - F.col("common")
    return checked.filter(100 * F.col("common") >= cfg.percent * union).select("a", "b")


def _ordered_pair(x: str, y: str, nx: str, ny: str) -> list:
    first = F.col(x) < F.col(y)
    return [
        F.least(x, y).alias("a"),
        F.greatest(x, y).alias("b"),
        F.when(first, F.col(nx)).otherwise(F.col(ny)).alias("na"),
        F.when(first, F.col(ny)).otherwise(F.col(nx)).alias("nb"),
    ]


class HeavyRegions:
    """The recursive join of regions whose shingle many sets share.

    A region is a shingle and a size class: linked sets are in one class or in
    neighbouring ones, so the sets of the next class are replicated as boundary. All
    sets here have fewer rare shingles than pivots, so pairs that share a rare one have
    been met in its region; what is left are pairs with only common shingles in common.
    """

    def __init__(self, heavy: DataFrame, cfg: JaccardConfig, scratch: Scratch):
        self.cfg, self.scratch = cfg, scratch
        size_class = F.floor(F.log(F.col("n").cast("double")) / -np.log(cfg.percent / 100)).cast("int")
        one = heavy.select("s", "set_id", "n", "h").distinct().withColumn("g", size_class)
        both = one.select("s", "g", "set_id", "n", "h", F.lit(True).alias("home")).union(
            one.select("s", F.col("g") - 1, "set_id", "n", "h", F.lit(False))
        )
        sized = both.groupBy("s", "g").agg(
            F.count(F.lit(1)).alias("members"), F.max("home").alias("any_home"), F.bit_xor(F.xxhash64("set_id", "home")).alias("same")
        )
        # regions with the same members are one region
        sized = scratch.save(sized.filter("members > 1 and any_home").groupBy("g", "members", "same").agg(F.min("s").alias("s")))
        total = sized.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
        self.common = scratch.save(sized.filter(F.col("members") * COMMON > total).select("s", "g"))
        self.members = scratch.save(self._joined(both, sized.select("s", "g")).drop("home"))

    def _joined(self, rows: DataFrame, one: DataFrame, how: str = "inner") -> DataFrame:
        """rows with what ``one`` says of their region; great regions are not gathered."""
        return join_spread(rows, one, ["s", "g"], self.common, how)

    def join(self, sets: DataFrame, known: DataFrame) -> DataFrame | None:
        """Verified pairs that, with the known links, connect all that is linked within these regions."""
        cfg, scratch = self.cfg, self.scratch
        if self.members.isEmpty():
            return None
        todo, checked = self._unsettled(self.members, components(known, scratch)), None
        for k in range(cfg.rounds):
            if todo.isEmpty():
                return checked
            # the pivot: of the members outside the largest component, the one with the smallest share of rare shingles
            order = F.struct((1 - F.col("h") / F.col("n")).alias("o"), F.xxhash64("set_id", F.lit(k)), F.col("set_id").alias("p"), F.col("n").alias("np"), F.col("h").alias("hp"))
            pivots = scratch.save(self._odd(todo).groupBy("s", "g").agg(F.min(order).alias("t")).select("s", "g", "t.p", "t.np", "t.hp"))
            met = self._joined(todo, pivots).withColumn("self", F.col("p") == F.col("set_id"))
            asked = met.filter(~F.col("self") & self._may("n", "np", "h", "hp"))
            pairs = scratch.save(asked.select(*_ordered_pair("set_id", "p", "n", "np")).distinct())
            new = scratch.save(verified(pairs, sets))
            checked = new if checked is None else checked.union(new)
            union = F.col("na") + F.col("nb") - F.col("common")
            far = new.select("a", "b", (1 - F.col("common") / union).alias("d"))
            met = met.withColumns({"a": F.least("set_id", "p"), "b": F.greatest("set_id", "p")}).join(far, ["a", "b"], "left")
            met = met.withColumn(f"d{k}", F.when(F.col("self"), 0.0).otherwise(F.col("d")))
            todo = met.select(*[c for c in todo.columns if c != "c"], f"d{k}")
            todo = self._unsettled(todo, components(known.union(links_of(checked, cfg)), scratch))
        if todo.isEmpty():
            return checked
        return checked.union(scratch.save(verified(self._rest(todo), sets)))

    def _may(self, nx: str, ny: str, hx: str, hy: str):
        """Whether sets of these sizes and numbers of common shingles can be linked without a rare one in common."""
        return (100 * F.least(nx, ny) >= self.cfg.percent * F.greatest(nx, ny)) & (F.least(hx, hy) >= least_common(nx, ny, self.cfg))

    def _marked(self, todo: DataFrame) -> DataFrame:
        """Members with odd: whether they are outside their region's largest component."""
        size = todo.groupBy("s", "g", "c").agg(F.count(F.lit(1)).alias("m"))
        top = size.groupBy("s", "g").agg(F.max(F.struct("m", "c")).alias("t")).select("s", "g", F.col("t.c").alias("top"))
        return self._joined(todo, self.scratch.save(top)).withColumn("odd", F.col("c") != F.col("top")).drop("top")

    def _odd(self, todo: DataFrame) -> DataFrame:
        return self._marked(todo).filter("odd").drop("odd")

    def _unsettled(self, members: DataFrame, label: DataFrame) -> DataFrame:
        """Members with their component, of the regions that have more than one."""
        c = members.join(label.withColumnRenamed("node", "set_id"), "set_id", "left")
        c = self.scratch.save(c.select(*members.columns, F.coalesce("component", "set_id").alias("c")))
        open_ = c.groupBy("s", "g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
        return self.scratch.save(self._joined(c, open_.select("s", "g")))

    def _rest(self, todo: DataFrame) -> DataFrame:
        """Pairs of different components that no pivot settles, at least one of them outside the largest.

        By the triangle inequality linked sets have distances to any pivot that differ by at most t. A pair that
        meets in several regions is made in the first of them only.
        """
        far = [c for c in todo.columns if c[0] == "d"]
        where = todo.groupBy("g", "set_id").agg(F.collect_set("s").alias("ss"))
        marked = self.scratch.save(self._marked(todo).join(where, ["g", "set_id"]))
        odd = marked.filter("odd").select("s", "g", *[F.col(c).alias(f"{c}_x") for c in ("set_id", "n", "h", "c", "ss", *far)])
        near = F.lit(True)
        for d in far:
            near &= F.coalesce(F.abs(F.col(d) - F.col(f"{d}_x")) <= 1 - self.cfg.percent / 100 + 1e-9, F.lit(True))
        once = (~F.col("odd") | (F.col("set_id") < F.col("set_id_x"))) & (F.array_min(F.array_intersect("ss", "ss_x")) == F.col("s"))
        met = odd.join(marked, ["s", "g"]).filter((F.col("c_x") != F.col("c")) & self._may("n", "n_x", "h", "h_x") & near & once)
        return self.scratch.save(met.select(*_ordered_pair("set_id", "set_id_x", "n", "n_x")).distinct())


def jaccard_components(docs: DataFrame, cfg: JaccardConfig = JaccardConfig(), text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    n_parts = parts(spark, docs)
    cfg = replace(cfg, bits=cfg.bits or sketch_bits(docs, text_col))
    while True:
        first = scratch.save(signatures(docs, cfg, text_col))
        sig = first.filter("chunk is null")
        # if two different sets have the same number, all are numbered anew with another seed
        if sig.groupBy("set_id").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").isEmpty():
            break
        scratch.drop(first)
        cfg = replace(cfg, seed=cfg.seed + 1)
    sig = sig.select("doc_id", "n", "set_id")
    heavy = heavy_cells(first.filter("chunk is not null"), cfg)
    table = scratch.save(entries(docs, heavy, cfg, text_col))
    pairs = scratch.save(light_pairs(table.filter("not heavy"), cfg, n_parts))
    regions = HeavyRegions(table.filter("heavy"), cfg, scratch)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("x")).union(regions.members.select("set_id"))
    sets = candidate_sets(docs, asked, cfg, text_col, scratch)
    scratch.drop(table)
    found = scratch.save(links_of(verified(pairs, sets), cfg))
    more = regions.join(sets, found)
    links = found if more is None else found.union(links_of(more, cfg))
    label = components(links, scratch)  # of sets
    own = sig.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = own.join(label.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("c", F.coalesce("component", "set_id"))
    # a component is named by the smallest document in it
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    of_set = scratch.save(named.join(least, "c").select("set_id", "component_id"))
    out = sig.join(of_set, "set_id", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id, once."""
    keep = jaccard_components(docs, cfg).filter("doc_id <=> component_id").select("doc_id").distinct()
    rows = packed_up(docs, "doc_id").withColumn("_order", F.xxhash64("_in"))
    kept = rows.join(keep, rows["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
    w = Window.partitionBy("doc_id").orderBy("_order")
    return unpacked(kept.withColumn("_row", F.row_number().over(w)).filter("_row = 1"), docs.columns)
