"""Secret scan with corpus-wide ownership frequency.

Candidates are found by pattern in every text. The hash of each candidate's
value is then counted over the whole corpus by distinct repositories and
distinct owners: a value that many owners carry is a widely copied example, a
random-looking value that stays with its owner looks live. Counting is done in
two steps, (value, owner, repository) before (value), so a value held by a third
of all rows is combined before it is shuffled. The verdicts go back to the
candidates by a join on the value; very common values, of which there are few,
are broadcast for it. Column functions only.

Defined cases: null text is empty; a null owner or repository counts as one
owner or repository of its own; repeated rows add nothing to distinct counts;
an empty table gives an empty result; spans that start together are listed in the
order of their kinds; texts and values of any length are worked whole; in
scan_secrets added columns replace kept ones of their names, in redact_secrets all
columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import COMMON, Scratch, join_spread, let, packed_up, unpacked, without
from .spans import find_spans, listed, of_kind, redacted, tagged

# The base patterns, and well-known public token formats that the method adds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_PARTS = r"""^((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(.*)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
_PEM = r"(?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY-----"
MORE = {
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "forge": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})",
    "pay": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "chat": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    # a key from header to footer; its own headers hold a few dashes, its body none. Without a footer only the header.
    "pem": rf"-----BEGIN {_PEM}(?:[^-]*(?:-{{1,4}}[^-]+){{0,16}}-----END {_PEM})?",
}
KINDS = ["assign", "access", "hex", *MORE]
ADDED = [
    "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "n_weak", "live",
]
INNER = ["_owner", "_repo", "_found", "_row", "judged"]
FOUND = "array<struct<start:int,rank:int,end:int,kind:string,base:boolean,m:string>>"


@dataclass(frozen=True)
class SecretConfig:
    """max_owners: a value with more distinct owners is an example.

    max_repositories: so is one in more distinct repositories of few owners.
    min_distinct: a live-looking value has at least so many different characters.
    """

    max_owners: int = 2
    max_repositories: int = 8
    min_distinct: int = 8


def candidates(text: Column) -> Column:
    """All candidate spans of a text, base and added; added ones inside a base span are left out."""
    base = F.concat(
        tagged(find_spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN_PARTS, 2)) >= 12), "assign", 0, True),
        tagged(find_spans(text, ACCESS), "access", 1, True),
        tagged(find_spans(text, HEX), "hex", 2, True),
    )
    more = F.concat(*[tagged(find_spans(text, p), k, 3 + i, False) for i, (k, p) in enumerate(MORE.items())])
    # one pass decides whether any of the added patterns can match at all
    hint = text.rlike(r"eyJ|gh[pousr]_|glpat-|[sr]k_(?:live|test)_|xox[abprs]-|-----BEGIN ")
    more = F.when(hint, more).otherwise(F.array().cast(FOUND))
    return let(
        base,
        lambda b: F.concat(
            b,
            F.filter(more, lambda x: ~F.exists(b, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))),
        ),
    )


def value_of(span: Column) -> Column:
    """The secret itself: of an assignment only what is assigned."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["m"], ASSIGN_PARTS, 2)).otherwise(span["m"])


def scan_secrets(
    docs: DataFrame,
    keep: list[str],
    cfg: SecretConfig = SecretConfig(),
    text_col: str = "text",
    owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """The ``keep`` columns of docs, with counts, spans and the live-looking spans (column ``live``)."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = scratch.save(
        docs.select(
            *[F.col(f"`{c}`") for c in keep if c.lower() not in {*ADDED, *INNER}],
            F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"),
            F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols]).alias("_repo"),
            candidates(text).alias("_found"),
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    each = found.filter(F.size("_found") > 0).select("_row", "_owner", "_repo", F.explode("_found").alias("s"))
    each = each.withColumn("value", F.sha2(value_of(F.col("s")), 256)).withColumn(
        "variety", F.size(F.array_distinct(F.split(value_of(F.col("s")), "")))
    )
    held = each.groupBy("value", "_owner", "_repo").agg(F.count(F.lit(1)).alias("n"))
    owned = held.groupBy("value", "_owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("rows"))
    spread = owned.groupBy("value").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories"), F.sum("rows").alias("rows")
    )
    example = (F.col("owners") > cfg.max_owners) | (F.col("repositories") > cfg.max_repositories)
    spread = scratch.save(spread.select("value", "rows", example.alias("example")))
    all_rows = spread.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    common = spread.filter(F.col("rows") * COMMON > all_rows).select("value")
    judged = join_spread(each, spread, ["value"], common).withColumn(
        "verdict",
        F.when(F.col("example"), "example").when(F.col("variety") >= cfg.min_distinct, "live").otherwise("weak"),
    )
    per_row = judged.groupBy("_row").agg(
        F.collect_list(F.struct("s", "verdict")).alias("judged")
    )
    out = found.join(per_row, "_row", "left")
    empty = F.array().cast(FOUND)

    def those(verdict: str) -> Column:
        return F.coalesce(
            F.transform(F.filter("judged", lambda j: j["verdict"] == verdict), lambda j: j["s"]), empty
        )

    base = F.filter("_found", lambda s: s["base"])
    live = those("live")
    return without(
        out.withColumns({
            "n_assign": of_kind(F.col("_found"), "assign"),
            "n_access": of_kind(F.col("_found"), "access"),
            "n_hex": of_kind(F.col("_found"), "hex"),
            "base_sha256": F.sha2(listed(base), 256),
            # added spans stand only where they look live
            "spans": listed(F.concat(base, F.filter(live, lambda s: ~s["base"]))),
            "n_live": F.size(live).cast("long"),
            "n_example": F.size(those("example")).cast("long"),
            "n_weak": F.size(those("weak")).cast("long"),
            "live": live,
        }),
        INNER,
    )


def redact_secrets(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """docs with every live-looking secret replaced in the text; widely copied examples stay."""
    out = scan_secrets(packed_up(docs, "text", "source", "lang"), ["_in"], cfg)
    return unpacked(out, docs.columns, text=redacted(F.col("_in.text"), F.col("live")))
