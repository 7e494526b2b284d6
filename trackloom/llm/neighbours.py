"""Nearest neighbours by score-aware quantisation.

Nearness by Euclidean distance is maximum inner product: x is nearest to q where
q.x - |x|^2/2 is greatest. Vectors are dealt to cells around centroids and coded with
four bits per pair of components. The code books are fitted score-aware: of the error
of a coded vector the part parallel to the vector weighs more, because it is that part
that shifts the inner products with the queries for which the vector matters. A query
visits the cells nearest to it, adds up the four-bit tables for all vectors there, and
the best of each block, with all that their coding error may have put behind these, are
ranked again by exact distance in double precision.

Centroids and code books are fitted on a bounded sample (``sample`` vectors, those with
the lowest hash); every vector is indexed. Cells have two levels, the second around
centroids of what the first leaves, so their number grows with the table while the sample
does not. Equal vectors are indexed and searched once: of the ids that share one only the
k + 1 smallest can be among anyone's nearest, and all queries that share one have the same
nearest but for their own ids. Vectors of a cell and queries that visit it are dealt to
blocks of bounded size, and each pair of blocks returns only its best for each query.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; ties go to the smaller id; a query with fewer
candidates gets all of them; rows that repeat an id are candidates each, but not for a
query of the same id; a query repeated with the same vector is one query, with different
vectors one for each; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import COMMON, Scratch, join_spread


@dataclass(frozen=True)
class NeighbourConfig:
    """k: neighbours; sample: vectors to fit on; per_cell: vectors in a cell; cells, split: most cells, and parts of each.

    sure: share of the sample's own neighbours that the visited cells must hold; least: candidates a query must meet;
    block, queries: vectors and queries of a cell that meet in one group; rerank: vectors of a block that are at
    least measured exactly for a query; eta: weight of the parallel error.
    """

    k: int = 10
    sample: int = 20_000
    per_cell: int = 1024
    cells: int = 1000
    split: int = 64
    sure: float = 0.98
    least: int = 2000
    block: int = 8192
    queries: int = 4096
    rerank: int = 120
    eta: float = 4.0
    rounds: int = 8


def usable(v: Column) -> Column:
    """Whether a vector takes part, apart from its length."""
    d = v.cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return d.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(d, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Centroids; an emptied one moves to the point worst served."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * (x @ c.T)
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            worst = np.argsort(-(d[np.arange(len(x)), near] + (x * x).sum(1)))
            c[n == 0] = x[worst[: int((n == 0).sum())]]
    return c


class Cells:
    """Centroids, and the same few centroids of their residuals within each; cell = centroid * parts + part."""

    def __init__(self, x: np.ndarray, total: int, cfg: NeighbourConfig):
        want = max(1, total // cfg.per_cell)
        self.coarse = kmeans(x, max(1, min(cfg.cells, len(x) // 20, want)), cfg.rounds)
        rest = x - self.coarse[self._near(x, self.coarse)]
        parts = max(1, min(cfg.split, len(x) // 20, -(-want // len(self.coarse))))
        self.fine = kmeans(rest, parts, cfg.rounds) if parts > 1 else np.zeros((1, x.shape[1]))
        self.centres = (self.coarse[:, None] + self.fine[None]).reshape(-1, x.shape[1])

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        one = self._near(x, self.coarse)
        return one * len(self.fine) + self._near(x - self.coarse[one], self.fine)

    def order(self, q: np.ndarray) -> np.ndarray:
        """All cells for each query, nearest centre first."""
        c = self.centres
        return np.argsort((c * c).sum(1) - 2 * q @ c.T, 1, kind="stable")


def probes_for(x: np.ndarray, cells: Cells, cfg: NeighbourConfig, queries: int = 256) -> int:
    """Cells to visit so that ``sure`` of the neighbours within the sample are met.

    Clustered vectors need few; for vectors without any structure it is most of the cells.
    """
    q = x[:queries]
    d = (x * x).sum(1) - 2 * q @ x.T
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(d, 1)[:, : min(cfg.k, len(x) - 1)]
    if not near.size:
        return len(cells.centres)
    place = np.argsort(cells.order(q), 1)
    return int(np.quantile(place[np.arange(len(q))[:, None], cells.of(x)[near]], cfg.sure)) + 1


class Codes:
    """Code books of 16 words for each group of components, fitted under the anisotropic loss.

    The loss of x coded as y is |r|^2 + (eta - 1) (r.u)^2 with r = x - y and u = x/|x|.
    """

    def __init__(self, x: np.ndarray, eta: float, rounds: int):
        self.eta, self.dim = eta, x.shape[1]
        self.groups = np.array_split(np.arange(self.dim), max(1, (self.dim + 1) // 2))
        k = min(16, len(x))
        self.books = [np.resize(kmeans(x[:, g], k, 10, 11 + i), (16, len(g))) for i, g in enumerate(self.groups)]
        for _ in range(rounds if len(x) >= 256 else 0):
            self.refit(x, self.encode(x))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent: each group in turn takes the word that makes the whole loss least."""
        u = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        codes = np.stack(
            [((b * b).sum(1) - 2 * x[:, g] @ b.T).argmin(1) for g, b in zip(self.groups, self.books, strict=True)], 1
        ).astype(np.uint8)
        along = ((x - self.decode(codes)) * u).sum(1)
        for _ in range(sweeps):
            for m, (g, b) in enumerate(zip(self.groups, self.books, strict=True)):
                r = x[:, None, g] - b[None]  # vectors x words x components
                proj = (r * u[:, None, g]).sum(2)
                rest = along - proj[np.arange(len(x)), codes[:, m]]
                loss = (r * r).sum(2) + (self.eta - 1) * (rest[:, None] + proj) ** 2
                codes[:, m] = loss.argmin(1)
                along = rest + proj[np.arange(len(x)), codes[:, m]]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Least squares for all words together, given the codes."""
        u = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        at, place = 0, np.zeros((len(x), self.dim), np.int64)
        for m, g in enumerate(self.groups):
            place[:, g] = at + codes[:, [m]].astype(np.int64) * len(g) + np.arange(len(g))
            at += 16 * len(g)
        a, rhs = np.zeros((at, at)), np.zeros(at)
        for i in range(0, len(x), 4096):
            p, ux, xx = place[i : i + 4096], u[i : i + 4096], x[i : i + 4096]
            dense = np.zeros((len(p), at))
            np.put_along_axis(dense, p, ux, 1)
            a += (self.eta - 1) * dense.T @ dense
            a[np.arange(at), np.arange(at)] += np.bincount(p.ravel(), minlength=at)
            rhs += np.bincount(p.ravel(), (xx + (self.eta - 1) * (xx * ux).sum(1, keepdims=True) * ux).ravel(), at)
        free = np.diag(a) > 0
        a[np.arange(at), np.arange(at)] += np.where(free, 1e-6, 1.0)
        new, at = np.linalg.solve(a, rhs), 0
        for m, g in enumerate(self.groups):
            words = new[at : at + 16 * len(g)].reshape(16, len(g))
            used = free[at : at + 16 * len(g)].reshape(16, len(g)).all(1)
            self.books[m] = np.where(used[:, None], words, self.books[m])
            at += 16 * len(g)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Inner product of a query's groups with every word."""
        return np.stack([b @ q[g] for g, b in zip(self.groups, self.books, strict=True)])


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate((codes, np.zeros((len(codes), 1), np.uint8)), 1)
    return codes[:, ::2] | codes[:, 1::2] << 4


def table_scan(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Approximate inner products of a query with packed codes: one look-up a byte in tables of 256 sums."""
    if len(table) % 2:
        table = np.concatenate((table, np.zeros((1, 16))))
    pairs = (table[1::2, :, None] + table[::2, None, :]).reshape(len(table) // 2, 256)
    return pairs[np.arange(code.shape[1]), code].sum(1)


def nearest(
    vectors: DataFrame, is_query: Column, cfg: NeighbourConfig = NeighbourConfig(), id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of each row for which is_query holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + 0.0)  # no negative zeros: equal vectors have equal keys
    base = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    lengths = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["d"]
    key = ["h1", "h2"]
    keyed = base.filter(F.size("v") == dim).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # a row for each vector and id, however often it is repeated
    rows = scratch.save(keyed.groupBy(*key, "vec_id").agg(F.first("v").alias("v"), F.max("q").alias("q"), F.count(F.lit(1)).alias("n")))
    least = F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))
    few = rows.select(*key, "vec_id", "v", "n", least.alias("r")).filter(F.col("r") <= cfg.k + 1)
    held = F.sort_array(F.collect_list(F.struct("vec_id", "n")))  # k + 1 at most
    distinct = few.groupBy(*key).agg(F.first("v").alias("v"), held.alias("o"))
    distinct = scratch.save(distinct.select(*key, "v", F.col("o.vec_id").alias("ids"), F.col("o.n").alias("ns")))

    total = distinct.count()
    sample = distinct.orderBy(*key).limit(cfg.sample).select("v").toPandas()
    x = np.array(sample["v"].tolist(), float).reshape(-1, dim)
    cells = Cells(x, total, cfg)
    n_cells, probes = len(cells.centres), probes_for(x, cells, cfg)
    model = spark.sparkContext.broadcast((cells, Codes(x, cfg.eta, 3)))

    def index(batches):
        cells, codes = model.value
        for pdf in batches:
            for i in range(0, len(pdf), 2048):
                part = pdf.iloc[i : i + 2048]
                w = np.array(part["v"].tolist(), float).reshape(-1, dim)
                code = codes.encode(w)
                yield part.assign(
                    cell=cells.of(w).astype(np.int32), code=[c.tobytes() for c in packed(code)],
                    err=np.sqrt(((w - codes.decode(code)) ** 2).sum(1)),
                )

    kinds = "h1 long, h2 long, v array<double>, ids array<long>, ns array<long>"
    indexed = scratch.save(distinct.mapInPandas(index, f"{kinds}, cell int, code binary, err double"))
    filled = np.zeros(n_cells, np.int64)
    for r in indexed.groupBy("cell").count().collect():  # a row a cell
        filled[r["cell"]] = r["count"]
    blocks = np.maximum(1, -(-filled // cfg.block))

    # an id with several vectors is no candidate for any of its queries, so these are searched each by itself
    lo_hi = rows.groupBy("vec_id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi"))
    several = lo_hi.filter("lo <> hi").select("vec_id", F.lit(True).alias("alone"))
    asked = rows.filter("q").select(*key, "v", "vec_id").join(several, "vec_id", "left")
    asked = asked.withColumn("alone", F.coalesce("alone", F.lit(False)))
    asked = scratch.save(asked.withColumn("own", F.when(F.col("alone"), F.col("vec_id")).otherwise(F.lit(0))))
    unit = [*key, "own", "alone"]

    def probe(batches):
        cells, _ = model.value
        step = max(1, min(256, (1 << 21) // n_cells))
        for pdf in batches:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                at, cell, block = [], [], []
                for j, order in enumerate(cells.order(np.array(part["qv"].tolist(), float).reshape(-1, dim))):
                    met = np.cumsum(filled[order])
                    mine = order[: max(probes, int(np.searchsorted(met, cfg.least)) + 1)]
                    mine = mine[filled[mine] > 0]
                    n = blocks[mine]
                    at.append(np.full(n.sum(), j))
                    cell.append(np.repeat(mine, n))
                    block.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                yield part.iloc[np.concatenate(at)].assign(
                    cell=np.concatenate(cell).astype(np.int32), block=np.concatenate(block).astype(np.int32)
                )

    units = asked.groupBy(*unit).agg(F.first("v").alias("qv"))
    visits = scratch.save(units.mapInPandas(probe, "h1 long, h2 long, own long, alone boolean, qv array<double>, cell int, block int"))
    shares = visits.filter("block = 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cfg.queries).cast("int").alias("shares"))
    parts = F.broadcast(shares)  # a row a cell
    held = spark.createDataFrame([(c, int(blocks[c])) for c in np.flatnonzero(blocks > 1).tolist()], "cell int, blocks int")
    share = F.pmod(F.xxhash64(*unit, F.lit(2)), F.col("shares")).cast("int")
    queries = visits.join(parts, "cell").select(*unit, "qv", "cell", "block", share.alias("share"))
    block = F.pmod(F.xxhash64(*key, F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int")
    stored = indexed.join(parts, "cell").join(F.broadcast(held), "cell", "left").select(
        "v", "ids", "ns", "code", "err", "cell", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    )

    def rank(group, vecs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in (*unit, "score", "vec_id", "n")}
        if len(vecs) and len(qs):
            # ties at the edge go to smaller ids, which stand first
            vecs = vecs.iloc[np.argsort([i[0] for i in vecs["ids"]], kind="stable")]
            v, many = np.array(vecs["v"].tolist(), float).reshape(-1, dim), np.array([len(i) for i in vecs["ids"]])
            ids, ns, start = np.concatenate(vecs["ids"].tolist()), np.concatenate(vecs["ns"].tolist()), np.cumsum(many) - many
            code = np.frombuffer(b"".join(vecs["code"]), np.uint8).reshape(len(v), -1)
            half = (v * v).sum(1) / 2
            # an inner product of a query with an error of length e is seldom more than three times |q| e / sqrt(dim)
            slack = vecs["err"].to_numpy() * 3 / dim**0.5
            for h1, h2, own, alone, q in zip(qs["h1"], qs["h2"], qs["own"], qs["alone"], qs["qv"], strict=True):
                approx = half - table_scan(code, model.value[1].table(q))
                other = ids != own if alone else np.ones(len(ids), bool)
                may = np.logical_or.reduceat(other, start)
                best = np.argsort(np.where(may, approx, np.inf), kind="stable")[: cfg.rerank]
                best = best[may[best]]
                if len(best) > cfg.k:
                    # whatever may still beat the last of these that counts is measured too
                    bound = np.partition(half[best] - v[best] @ q, cfg.k)[cfg.k]
                    best = np.union1d(best, np.flatnonzero(may & (approx - slack * np.sqrt(q @ q) <= bound)))
                if not len(best):
                    continue
                exact = np.repeat(np.sqrt(((v[best] - q) ** 2).sum(1)), many[best])
                at = np.repeat(start[best] - (np.cumsum(many[best]) - many[best]), many[best]) + np.arange(len(exact))
                exact, at = exact[other[at]], at[other[at]]
                top = np.lexsort((ids[at], exact))[: cfg.k + 1]
                for c, x in zip(unit, (h1, h2, own, alone), strict=True):
                    out[c] += [x] * len(top)
                out["score"] += exact[top].tolist()
                out["vec_id"] += ids[at][top].tolist()
                out["n"] += ns[at][top].tolist()
        return pd.DataFrame(out)

    meet = ["cell", "block", "share"]
    found = stored.groupBy(*meet).cogroup(queries.groupBy(*meet)).applyInPandas(
        rank, "h1 long, h2 long, own long, alone boolean, score double, vec_id long, n long"
    )
    place = F.row_number().over(Window.partitionBy(*unit).orderBy("score", "vec_id"))
    best = found.withColumn("r", place).filter(F.col("r") <= cfg.k + 1)
    hits = scratch.save(best.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "n"))).alias("hits")))
    # queries that share a vector share its hits
    sharing = asked.groupBy(*unit).agg(F.count(F.lit(1)).alias("m"))
    common = sharing.filter(F.col("m") * COMMON > asked.count()).select(*unit)
    each = join_spread(asked.select(F.col("vec_id").alias("query_id"), *unit), hits, unit, common)
    own_out = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    repeated = F.flatten(F.transform(own_out, lambda h: F.array_repeat(h, F.least(h["n"], F.lit(cfg.k)).cast("int"))))
    return each.select("query_id", F.posexplode(F.slice(repeated, 1, cfg.k)).alias("pos", "h")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score")
    )
