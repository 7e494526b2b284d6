"""Personal data by weak supervision.

Patterns propose spans. Several labelers vote on each: the strict form of the
pattern, a gazetteer (domain endings, dialling codes, name lists), the words
before the span, a checksum, and the shape of the value. Expectation-maximisation
over the table of vote patterns (a few hundred rows at any corpus size) estimates
how far each labeler can be trusted, and its posteriors are the soft labels of a
final naive-Bayes span classifier, whose counts are one grouped sum over all
candidates. Spans of the base rules always stay; other candidates are added when
the classifier is sure. Only column functions run on the data; the driver holds
the two bounded tables.

Defined cases: null text is empty; an empty table gives an empty result; every
row is judged on its own, so repeated rows repeat; spans that start together are
listed in the order of their kinds; texts and matches of any length are worked
whole; in detect_pii added columns replace kept ones of their names, in redact_pii
all columns stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, packed_up, unpacked
from .spans import find_spans, listed, of_kind, redacted, tagged

# Base patterns. Runs are matched from their start only, which keeps long ones linear; possessive
# groups are matched in a loop, so a domain may have any number of labels.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_OK = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?>(?:[\x20-]?[0-9]){11,18})(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Forms that only the method looks for.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
}
# Word lists of the gazetteer and context labelers.
ENDINGS = "com org net edu gov info io de fr es uk eu it nl ch at us ca".split()
GIVEN = (
    "anna maria john james robert mary linda peter paul michael thomas julia laura david daniel "
    "carlos jose ana pierre jean claire hans petra klaus sofia lucas emma marie"
).split()
CUES = {
    "email": "mail e-mail email contact write reach correo courriel kontakt",
    "ip": "ip address server host adresse dirección",
    "card": "card visa mastercard credit amex karte tarjeta carte payment",
    "phone": "call phone tel telephone mobile fax ring telefon teléfono téléphone",
    "ssn": "ssn social security insurance",
    "iban": "iban account bank konto cuenta compte",
    "name": "name dear contact by signed regards",
}
AGAINST = "version isbn order invoice serial figure page section chapter sku item model build".split()
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "name"]
LABELERS = ["pattern", "gazetteer", "context", "checksum", "shape"]
ADDED = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "found"]
FOUND = "array<struct<start:int,rank:int,end:int,kind:string,base:boolean,m:string>>"


@dataclass(frozen=True)
class PiiConfig:
    """sure: posterior above which an added candidate stands; rounds: EM iterations; context: characters before."""

    sure: float = 0.9
    rounds: int = 25
    context: int = 32


def digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m have a valid Luhn sum."""

    def total(d: Column) -> Column:
        n = F.length(d)
        return F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0),
            lambda a, i: a
            + let(
                F.substring(d, i, F.lit(1)).cast("int"),
                lambda x: F.when((n - i) % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)),
            ),
        )

    return let(digits(m), lambda d: total(d) % 10 == 0)


def base_spans(text: Column) -> Column:
    """Spans of the base rules. A text without the character that a kind needs is not searched for it."""
    none = F.array().cast(FOUND)
    digit = text.rlike("[0-9]")
    email = F.when(text.contains("@"), tagged(find_spans(text, EMAIL), "email", 0, True)).otherwise(none)
    ip = F.when(digit, tagged(find_spans(text, IP, lambda m: m.rlike(IP_OK)), "ip", 1, True)).otherwise(none)
    card = F.when(digit, tagged(find_spans(text, CARD, luhn), "card", 2, True)).otherwise(none)
    phone = F.when(
        text.contains("+"),
        tagged(find_spans(text, PHONE, lambda m: F.length(digits(m)).between(9, 15)), "phone", 3, True),
    ).otherwise(none)
    return F.concat(email, ip, card, phone)


def more_spans(text: Column) -> Column:
    """Candidates that the base rules do not have."""
    none = F.array().cast(FOUND)
    digit = text.rlike("[0-9]{4}")
    needs = {
        "email": text.rlike(r"(?i)[\[(]\x20?at\x20?[\])]"),
        "phone": digit,
        "ssn": digit,
        "iban": digit,
        "name": text.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?)\.?\x20\p{Lu}"),
    }
    return F.concat(*[
        F.when(needs[k], tagged(find_spans(text, p), k, KINDS.index(k), False)).otherwise(none)
        for k, p in MORE.items()
    ])


def votes(kind: Column, base: Column, m: Column, before: Column) -> Column:
    """array<int> of -1, 0 (abstains) or 1, one for each of LABELERS."""
    low = F.lower(before)
    d = digits(m)
    any_of = lambda words: rf"\b(?:{'|'.join(words)})\b"
    context = F.when(low.rlike(any_of(AGAINST)), -1)
    for k, cue in CUES.items():
        context = context.when((kind == k) & low.rlike(any_of(cue.split())), 1)
    gazetteer = (
        F.when(
            kind == "email",
            # an ending is short, so only the last characters of a match are searched for it
            F.when(F.lower(F.regexp_extract(F.substring(m, -64, 64), r"([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS), 1).otherwise(-1),
        )
        .when((kind == "name") & F.lower(m).rlike(any_of(GIVEN)), 1)
        .when((kind == "iban") & ~F.substring(m, 1, 2).isin("DE", "FR", "ES", "GB", "IT", "NL", "CH", "AT", "BE"), -1)
        .when((kind == "phone") & m.rlike(r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])"), 1)
        .when((kind == "ssn") & m.rlike(r"^(?:000|666|9)"), -1)
    )
    checksum = F.when(kind == "card", F.when(luhn(m), 1).otherwise(-1))
    shape = F.when((F.length(d) >= 6) & (F.size(F.array_distinct(F.split(d, ""))) <= 2), -1)
    marks = [F.when(base, 1).otherwise(0), gazetteer, context, checksum, shape]
    return F.array(*[F.coalesce(x.cast("int"), F.lit(0)) for x in marks])


def features(kind: Column, m: Column, before: Column) -> Column:
    """array<string> of bounded features for the final classifier."""
    f = [
        F.concat(F.lit("len="), F.least(F.length(m), F.lit(40)).cast("string")),
        F.concat(F.lit("digits="), F.least(F.length(digits(m)), F.lit(20)).cast("string")),
        F.concat(
            F.lit("word="),
            F.pmod(F.xxhash64(F.lower(F.regexp_extract(before, r"(\S+)\s*$", 1))), F.lit(64)).cast("string"),
        ),
        F.concat(F.lit("edge="), F.when(before.rlike(r"[\s(\[<\"']$") | (before == ""), 1).otherwise(0).cast("string")),
    ]
    return F.transform(F.array(*f), lambda x: F.concat(kind, F.lit(":"), x))


def expect_maximise(rows: list[tuple[str, tuple[int, ...], int]], rounds: int) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) by EM over counted vote patterns.

    Each labeler has, for each kind, the chance to vote +1, 0 or -1 on true and on
    false candidates, smoothed towards a mildly reliable labeler.
    """
    out = {}
    for kind in sorted({r[0] for r in rows}):
        own = [(v, n) for k, v, n in rows if k == kind]
        post = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in own}
        for _ in range(rounds):
            yes = sum(n * post[v] for v, n in own)
            no = sum(n * (1 - post[v]) for v, n in own)
            prior = (yes + 1) / (yes + no + 2)

            def chance(i: int, vote: int, true: bool) -> float:
                lean = {1: 3.0, 0: 2.0, -1: 1.0} if true else {1: 1.0, 0: 2.0, -1: 3.0}
                got = sum(n * (post[v] if true else 1 - post[v]) for v, n in own if v[i] == vote)
                return (got + lean[vote]) / ((yes if true else no) + 6.0)

            table = {
                (i, x, t): math.log(chance(i, x, t)) for i in range(len(LABELERS)) for x in (-1, 0, 1) for t in (True, False)
            }
            post = {
                v: 1
                / (
                    1
                    + math.exp(
                        min(
                            60.0,
                            math.log((1 - prior) / prior)
                            + sum(table[i, x, False] - table[i, x, True] for i, x in enumerate(v)),
                        )
                    )
                )
                for v, _ in own
            }
        out |= {(kind, v): p for v, p in post.items()}
    return out


def as_map(values: dict[str, float]) -> Column:
    """A constant map column; values has a bounded number of entries."""
    items = ", ".join(f"'{k}', {v!r}D" for k, v in sorted(values.items())) or "'', 0D"
    return F.expr(f"map({items})")


def detect_pii(docs: DataFrame, keep: list[str], cfg: PiiConfig = PiiConfig(), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of docs with counts, digests and the spans found (column ``found``)."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    inside = lambda x, b: F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    spans = let(base_spans(text), lambda b: F.concat(b, F.filter(more_spans(text), lambda x: ~inside(x, b))))
    described = F.transform(
        spans,
        lambda s: let(
            F.substring(text, F.greatest(s["start"] - cfg.context, F.lit(0)) + 1, F.least(s["start"], F.lit(cfg.context))),
            lambda before: F.struct(
                s.alias("span"),
                votes(s["kind"], s["base"], s["m"], before).alias("votes"),
                features(s["kind"], s["m"], before).alias("features"),
            ),
        ),
    )
    names = [c for c in keep if c.lower() not in {*ADDED, "_cand"}]
    found = scratch.save(docs.select(*[F.col(f"`{c}`") for c in names], described.alias("_cand")))
    each = found.filter(F.size("_cand") > 0).select(F.explode("_cand").alias("c")).select("c.*")

    # at most kinds x 3^labelers rows, whatever the corpus
    counted = each.groupBy("span.kind", "votes").count().collect()
    post = expect_maximise([(r["kind"], tuple(r["votes"]), r["count"]) for r in counted], cfg.rounds)
    post_map = as_map({f"{k}:{','.join(map(str, v))}": p for (k, v), p in post.items()})
    key = F.concat(F.col("span.kind"), F.lit(":"), F.array_join(F.col("votes").cast("array<string>"), ","))
    soft = each.withColumn("p", F.element_at(post_map, key))
    # at most kinds x feature values rows
    sums = (
        soft.select(F.col("span.kind").alias("kind"), "p", F.explode(F.array_append("features", F.concat(F.col("span.kind"), F.lit(":")))).alias("f"))
        .groupBy("f")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
        .collect()
    )
    totals = {r["f"]: (r["yes"] + 1, r["no"] + 1) for r in sums if r["f"].endswith(":")}
    weight = {k: math.log(y / n) for k, (y, n) in totals.items()}
    for r in sums:
        if not r["f"].endswith(":"):
            y, n = totals[r["f"].split(":")[0] + ":"]
            weight[r["f"]] = math.log((r["yes"] + 1) / (y + 1)) - math.log((r["no"] + 1) / (n + 1))
    w = as_map(weight)

    def stands(c: Column) -> Column:
        kind = c["span"]["kind"]
        score = F.aggregate(
            c["features"],
            F.coalesce(F.element_at(w, F.concat(kind, F.lit(":"))), F.lit(0.0)),
            lambda a, f: a + F.coalesce(F.element_at(w, f), F.lit(0.0)),
        )
        label = F.element_at(post_map, F.concat(kind, F.lit(":"), F.array_join(c["votes"].cast("array<string>"), ",")))
        # the votes on a span and what the classifier has learnt from all of them must agree
        return c["span"]["base"] | ((label > 0.5) & (1 / (1 + F.exp(-score)) > cfg.sure))

    final = F.transform(F.filter("_cand", stands), lambda c: c["span"])
    base = F.filter(F.col("found"), lambda s: s["base"])
    out = found.withColumn("found", final)
    return out.withColumns({
        **{f"n_{k}": of_kind(F.col("found"), k) for k in ("email", "ip", "card", "phone")},
        "base_sha256": F.sha2(listed(base), 256),
        "spans": listed(F.col("found")),
        "n_added": F.size(F.filter(F.col("found"), lambda s: ~s["base"])).cast("long"),
    }).drop("_cand")


def redact_pii(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """docs with the spans found replaced in the text by their kind."""
    out = detect_pii(packed_up(docs, "text"), ["_in"], cfg)
    return unpacked(out, docs.columns, text=redacted(F.col("_in.text"), F.col("found")))
