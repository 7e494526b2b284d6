"""Regular-expression spans as column functions.

Spark returns the matches of a pattern but not their places. The places follow
from the text between the matches: split() and regexp_extract_all() walk the
same matches, so start and end are running sums of lengths, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "struct<start:int,end:int,m:string>"


def find_spans(text: Column, pattern: str, ok=None) -> Column:
    """array<struct<start,end,m>>: leftmost non-overlapping matches, in order.

    ok: a predicate on the matched string; the failing ones are dropped after
    matching, so they still use up the text they cover.
    """

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        put = let(
            gaps,
            lambda g: F.aggregate(
                found,
                F.struct(
                    F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(f"array<{SPAN}>").alias("out")
                ),
                lambda a, m: let(
                    a["at"] + F.length(F.get(g, a["k"])),
                    lambda s: F.struct(
                        (s + F.length(m)).alias("at"),
                        (a["k"] + 1).alias("k"),
                        F.when(
                            ok(m) if ok else F.lit(True),
                            F.array_append(
                                a["out"], F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("m"))
                            ),
                        )
                        .otherwise(a["out"])
                        .alias("out"),
                    ),
                ),
                lambda a: a["out"],
            ),
        )
        none = F.array().cast(f"array<{SPAN}>")
        return F.when(F.size(F.filter(found, ok) if ok else found) == 0, none).otherwise(put)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def tagged(spans: Column, kind: str, rank: int, base: bool) -> Column:
    """The spans with their kind, its rank among the kinds, and whether the base rules found them."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            s["m"].alias("m"),
        ),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span by start, then rank, comma-joined."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def of_kind(spans: Column, kind: str) -> Column:
    """How many base spans of a kind there are."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first one names the cut."""
    done = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(
                    a["out"],
                    F.substring(text, a["at"] + 1, s["start"] - a["at"]),
                    F.lit("<"),
                    s["kind"],
                    F.lit(">"),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(done)
