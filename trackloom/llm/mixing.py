"""Soft-membership mixing.

A classifier fitted on the labelled table gives every document posteriors over domains.
Rates, one nonnegative number per document, are then fitted so that the expected tokens
of each domain, the sum over documents of rate x tokens x posterior, match the targets:
least squares of the totals with a small pull towards a rate of 1, by projected gradient.
A step goes from 1 against the gradient, which is the document's posteriors times one
number per domain, and is projected to [0, most]. The step is scaled by the domains'
token-weighted Gram matrix over the documents that the projection leaves free, so few
steps are needed, and no state per document is kept between them: each is a sum over all
documents that is combined before it is shuffled.

The classifier is multinomial logistic regression over words, beginnings of words and a few
whole-text marks, all of them whose spread over the domains is significant. It is fitted on a
bounded sample of labelled rows (``sample``, those with the lowest hash of their id), of which
the driver gets the marks that count; everything else covers all documents. Column functions only.

Defined cases: null text has no tokens, is judged as an empty text and gets the rate that
follows; tokens are words between white space; labels that are null or whose document is missing are not used; without labels all
documents are of the first domain; a domain nobody belongs to cannot meet its target and
the nearest totals are fitted; repeated rows count as documents of their own; an empty
table gives an empty result; texts of any length are judged whole; in mix added columns
replace kept ones of their names, in resample all columns stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, let, packed_up, unpacked

ADDED = ["n_words", "posteriors", "rate"]


@dataclass(frozen=True)
class MixConfig:
    """targets: share of all tokens that each domain shall have, in the order of the domains.

    sample: labelled rows to fit on; least, clear: documents with a mark and chi-square of its spread over the domains
    before it counts, in a table of ``slots`` or more; penalty, rounds: of the regression; most: greatest rate;
    pull: weight of staying at a rate of 1, in shares of all tokens; steps: most gradient steps; tolerance: relative error of the totals to stop at;
    sure: fractional part of a rate that counts as a whole copy when rows are drawn.
    """

    targets: dict[str, float] = field(default_factory=lambda: {"clean": 0.95, "junk": 0.05, "toxic": 0.0})
    sample: int = 20_000
    slots: int = 1 << 10
    least: int = 5
    clear: float = 20.0
    penalty: float = 0.1
    rounds: int = 80
    most: float = 8.0
    pull: float = 0.002
    steps: int = 20
    tolerance: float = 1e-7
    sure: float = 0.95


def domain_of(labels: DataFrame) -> Column:
    """The domain that a row of labels stands for."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")


def plain_words(text: Column) -> Column:
    """The lower-case words of a text; signs that repeat and bars are words of their own, other punctuation is none."""
    # the look-ahead spares letters the three alternatives
    bare = F.regexp_replace(F.lower(text), r"(?=\p{Punct})(?:(\p{Punct})\1+|(\|)|[.,;:!?\"'()])", " $1$1$2 ")
    return F.filter(F.split(bare, SPACE), lambda w: w != "")


def marks(text: Column) -> Column:
    """Hashes of what a text is judged by: its words, the first five letters of longer ones (inflected forms of
    a word share them), and in coarse steps how often words repeat, how many there are, and the share of capitals."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def found(ws: Column) -> Column:
        many = F.greatest(F.size(ws), F.lit(1))
        whole = lambda name, c: F.xxhash64(F.lit(name), F.floor(c).cast("long"))
        return let(F.array_distinct(ws), lambda u: F.concat(
            F.transform(u, lambda w: F.xxhash64(w)),
            F.transform(F.filter(u, lambda w: F.length(w) >= 5), lambda w: F.xxhash64(F.substring(w, 1, 5), F.lit("…"))),
            F.array(
                whole("repeated", 10 * (many - F.greatest(F.size(u), F.lit(1))) / many),
                whole("length", F.log2(many)),
                whole("capitals", 8 * capitals / F.greatest(F.length(text), F.lit(1))),
            ),
        ))

    return let(plain_words(text), found)


def constant(values: list, kind: str) -> Column:
    """A constant array that the optimizer folds once."""
    return F.from_json(F.lit(f"[{','.join(map(str, values))}]"), f"array<{kind}>")


@dataclass(frozen=True)
class Evidence:
    """The classifier: a weight of each domain, a table of the marks' hashes, each in one of its two slots, with their
    numbers, and the weights of each domain by number."""

    bias: list[float]
    table: list[int]
    number: list[int]
    weights: list[list[float]]


def fit_logistic(rows: list[list[int]], domain: list[int], n_marks: int, n_domains: int, cfg: MixConfig) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of the multinomial logistic regression with a squared penalty, by accelerated gradient steps.

    rows: the marks of each labelled document.
    """
    rows = [[*r, n_marks] for r in rows]  # the last mark, which all have, carries the bias
    size = np.array([len(r) for r in rows])
    at, mark = np.repeat(np.arange(len(rows)), size), np.fromiter((m for r in rows for m in r), np.int64, int(size.sum()))
    want = np.eye(n_domains)[domain]
    # marks are scaled by how often they occur, so that rare ones are learnt as fast as common ones
    scale = 1 / np.sqrt(np.maximum(np.bincount(mark, minlength=n_marks + 1), 1))[:, None]
    ridge = np.full((n_marks + 1, 1), cfg.penalty) * scale**2
    ridge[-1] = 0

    def scores(w: np.ndarray) -> np.ndarray:
        w = w * scale
        return np.stack([np.bincount(at, w[mark, i], len(rows)) for i in range(w.shape[1])], 1)

    def back(x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(mark, x[at, i], n_marks + 1) for i in range(x.shape[1])], 1) * scale

    v = np.ones((n_marks + 1, 1))
    for _ in range(30):  # the greatest curvature, by power iteration
        v = back(scores(v))
        norm = math.sqrt((v**2).sum())
        v = v / norm
    step = 1 / (0.55 * norm + ridge.max())
    w = w2 = np.zeros((n_marks + 1, n_domains))
    k = 1.0
    for _ in range(cfg.rounds):
        z = scores(w2)
        p = np.exp(z - z.max(1, keepdims=True))
        w3 = w2 - step * (back(p / p.sum(1, keepdims=True) - want) + ridge * w2)
        k3 = (1 + math.sqrt(1 + 4 * k * k)) / 2
        w2 = w3 + (k - 1) / k3 * (w3 - w)
        w, k = w3, k3
    w = w * scale
    return w[:-1], w[-1]


def places(w: int, size: int) -> tuple[int, int]:
    """The two slots that a hash may have."""
    return w % size, (w >> 32) % size


def numbered(best: list[int], slots: int) -> tuple[list[int], list[int]]:
    """The least table of ``slots`` or more, and four for each hash, in which each has one of its two slots alone;
    and the place of each in ``best``. An empty slot holds 0 and -1."""
    for size in count(max(slots, 4 * len(best), 1)):
        held: dict[int, int] = {}
        for i in range(len(best)):
            at, now = places(best[i], size)[0], i
            for _ in range(200):  # who was there moves to its other slot
                now, held[at] = held.get(at, -1), now
                if now < 0:
                    break
                p, q = places(best[now], size)
                at = q if at == p else p
            if now >= 0:
                break
        else:
            return [best[held[k]] if k in held else 0 for k in range(size)], [held.get(k, -1) for k in range(size)]
    raise AssertionError


def known_marks(found: Column, table: list[int], number: list[int]) -> Column:
    """The distinct numbers of the hashes in ``found``; all that the table lacks share the number after the last."""
    absent = max(number) + 1
    hashes, numbers = constant(table, "bigint"), constant([absent if n < 0 else n for n in number], "int")
    size = F.lit(len(table))
    one = lambda w: F.pmod(w, size).cast("int")
    two = lambda w: F.pmod(F.shiftright(w, 32), size).cast("int")

    def of(w: Column) -> Column:
        first = F.when(F.get(hashes, one(w)) == w, F.get(numbers, one(w)))
        return first.when(F.get(hashes, two(w)) == w, F.get(numbers, two(w))).otherwise(absent)

    return F.array_distinct(F.transform(found, of))


def fit_classifier(docs: DataFrame, labels: DataFrame, cfg: MixConfig, text_col: str) -> Evidence:
    """Logistic regression over all marks whose spread over the domains is significant, on the sampled labels."""
    names = list(cfg.targets)
    known = labels.select("doc_id", domain_of(labels).alias("domain")).filter("doc_id is not null").filter(F.col("domain").isin(*names))
    # at most cfg.sample short rows
    some = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(cfg.sample))
    scratch = Scratch(docs.sparkSession)
    met = scratch.save(docs.select("doc_id", F.coalesce(text_col, F.lit("")).alias("t")).join(some, "doc_id").select("domain", F.array_distinct(marks(F.col("t"))).alias("m")))
    sizes = {r["domain"]: r["count"] for r in met.groupBy("domain").count().collect()}
    n = [sizes.get(d, 0) for d in names]
    total = sum(n)
    if not total:
        return Evidence([0.0] + [-30.0] * (len(names) - 1), [0], [-1], [[0.0] for _ in names])
    counts = met.select("domain", F.explode("m").alias("w")).groupBy("w").agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(names)], F.count(F.lit(1)).alias("n"))
    off = sum((F.pow(F.col(f"n{i}") - F.col("n") * (k / total), 2) / (F.col("n") * (k / total)) for i, k in enumerate(n) if k), F.lit(0.0))
    # the sampled documents hold these, so their number is bounded by the sample too
    best = [r["w"] for r in counts.withColumn("off", off).filter((F.col("n") >= cfg.least) & (F.col("off") >= cfg.clear)).select("w").orderBy("w").collect()]
    table, number = numbered(best, cfg.slots)
    rows = met.select("domain", F.array_remove(known_marks(F.col("m"), table, number), len(best)).alias("s")).collect()
    scratch.drop(met)
    weights, bias = fit_logistic([r["s"] for r in rows], [names.index(r["domain"]) for r in rows], len(best), len(names), cfg)
    # a domain without labels has nothing to be fitted to
    bias = [float(b) if k else -30.0 for b, k in zip(bias, n, strict=True)]
    return Evidence(bias, table, number, [[round(float(x), 4) for x in weights[:, d]] or [0.0] for d in range(len(names))])


def posteriors(found: Column, evidence: Evidence) -> Column:
    """array<double>: the posterior of each domain, given a text's marks."""

    def scores(hit: Column) -> Column:
        def total(weights: Column) -> Column:
            return F.aggregate(hit, F.lit(0.0), lambda a, s: a + F.get(weights, s))

        return F.array(*[F.lit(p) + total(constant([*r, 0.0], "double")) for p, r in zip(evidence.bias, evidence.weights, strict=True)])

    def soft(s: Column) -> Column:
        return let(
            F.transform(s, lambda x: F.exp(x - F.array_max(s))),
            lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda z: F.transform(e, lambda x: x / z)),
        )

    return let(let(known_marks(found, evidence.table, evidence.number), scores), soft)


def rate_of(mu: list[float], p: Column, cfg: MixConfig) -> Column:
    """The rate of a document with posteriors p: one step from 1 along mu, projected to [0, most]."""
    step = sum((F.lit(m) * p[i] for i, m in enumerate(mu)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(cfg.most), F.lit(1.0) - step))


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Solution of a small symmetric system."""
    n = len(b)
    m = [[*a[i], b[i]] for i in range(n)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[k] = m[k], m[i]
        for r in range(n):
            if r != i and m[i][i]:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] if m[i][i] else 0.0 for i in range(n)]


def fit_rates(table: DataFrame, cfg: MixConfig, totals: list[float] | None = None) -> list[float]:
    """The step, one number per domain, that brings the expected domain totals of table(n_words, posteriors) to the targets.

    totals: absolute targets in tokens instead of the shares of cfg. At the solution the step is the remaining
    error of the totals over the pull, so a domain that nobody belongs to moves nothing far.
    """
    d = len(cfg.targets)
    t, p = F.col("n_words").cast("double"), F.col("posteriors")
    mu, tried, last, want = [0.0] * d, [0.0] * d, None, totals
    for _ in range(cfg.steps):
        r = rate_of(tried, p, cfg)
        free = F.when((r > 0) & (r < cfg.most), t).otherwise(0.0)
        row = table.agg(
            F.coalesce(F.sum(t), F.lit(0.0)).alias("all"),
            *[F.coalesce(F.sum(r * t * p[i]), F.lit(0.0)).alias(f"s{i}") for i in range(d)],
            *[F.coalesce(F.sum(free * p[i] * p[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)],
        ).first()
        if not row["all"]:
            break
        if want is None:
            want = [row["all"] * x for x in cfg.targets.values()]
        pull = cfg.pull * row["all"]
        miss = [pull * tried[i] - (row[f"s{i}"] - want[i]) for i in range(d)]
        size = math.sqrt(sum(x * x for x in miss))
        if last is not None and size >= last:  # too far: the projection holds other documents there
            tried = [(a + b) / 2 for a, b in zip(mu, tried, strict=True)]
            continue
        mu, last = tried, size
        if size <= cfg.tolerance * row["all"]:
            break
        gram = [[row[f"g{min(i, j)}_{max(i, j)}"] + (pull if i == j else 0.0) for j in range(d)] for i in range(d)]
        tried = [a - x for a, x in zip(mu, solve(gram, miss), strict=True)]
    return mu


def mix(docs: DataFrame, labels: DataFrame, cfg: MixConfig = MixConfig(), keep: list[str] | None = None, text_col: str = "text", hold: str | None = None) -> DataFrame:
    """The ``keep`` columns of docs (all, if None) with n_words, posteriors and rate.

    hold: a domain whose total shall stay what it is; the others get their share relative to it.
    """
    scratch = Scratch(docs.sparkSession)
    evidence = fit_classifier(docs, labels, cfg, text_col)
    names = [c for c in (keep or docs.columns) if c.lower() not in {*ADDED, "_text"}]
    base = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(text_col, F.lit("")).alias("_text"))
    scored = base.withColumns({
        "n_words": F.size(F.filter(F.split("_text", SPACE), lambda w: w != "")).cast("long"),
        "posteriors": posteriors(marks(F.col("_text")), evidence),
    }).drop("_text")
    table = scratch.save(scored)
    totals = None
    if hold is not None:
        k = list(cfg.targets).index(hold)
        now = table.agg(F.sum(F.col("n_words") * F.col("posteriors")[k])).first()[0] or 0.0
        totals = [now * x / cfg.targets[hold] for x in cfg.targets.values()]
    return table.withColumn("rate", rate_of(fit_rates(table, cfg, totals), F.col("posteriors"), cfg))


def copies(rate: Column, draw: Column, cfg: MixConfig) -> Column:
    """How often a row with this rate is kept: its whole part, and once more if draw, uniform in [0, 1), is below the rest.

    A rest of cfg.sure or more always counts as one, so documents that the fit leaves near 1 stay.
    """
    rest = rate - F.floor(rate)
    return (F.floor(rate) + F.when((rest >= cfg.sure) | (draw < rest), 1).otherwise(0)).cast("int")


def resample(docs: DataFrame, labels: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """docs with each row as often as its rate says: the fractional part is the chance of one more copy.

    The total of the first domain is held, so its documents have rates near 1 and stay. The draw is a hash of
    id and text, so it is the same in every run and equal rows share it; with it the expected totals of the
    domains are the fitted ones, but for rests rounded up to one from cfg.sure on.
    """
    rated = mix(packed_up(docs, "doc_id", "text"), labels, cfg, keep=["_in"], hold=next(iter(cfg.targets)))
    draw = F.pmod(F.xxhash64("_in.doc_id", "_in.text", F.lit("draw")), F.lit(1 << 30)) / F.lit(1 << 30)
    times = copies(F.col("rate"), draw, cfg)
    return unpacked(rated.filter(times >= 1).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))), docs.columns)
