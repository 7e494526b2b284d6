"""Line-first quality rules.

Every line is judged on its own: bare navigation, boilerplate, symbol noise,
shouting, and text without closing punctuation are failures; lines that repeat an
earlier one are only counted. Failing lines are removed and a document that loses too much of
its text goes as a whole. All of it is built from column functions, so nothing
leaves the JVM and nothing is shuffled.

Defined cases: a null text counts as no words and is rejected (base_failed);
an empty table gives an empty result; repeated rows are judged one by one;
texts and lines of any length are judged whole; a share exactly at a threshold
passes; in quality_rules added columns replace those of their names, in clean()
all columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, packed_up, unpacked, without

# Phrases that mark a line as boilerplate of a web page.
BOILERPLATE = (
    r"(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|all rights reserved|"
    r"subscribe|newsletter|sign (in|up)|log ?in|click here|read more|share (this|on)|lorem ipsum|"
    r"powered by|skip to (main )?content)\b"
)
# Characters that may close a line of prose, in ASCII or typographic form.
CLOSED = r"[.!?:;,\x{2026}][\"'\x29\x5D\x{201D}\x{00BB}\x{2019}]*\s*$"

ADDED = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
    "n_lines", "n_lines_removed", "kept_words", "kept", "cleaned",
]


@dataclass(frozen=True)
class QualityConfig:
    """Thresholds of the rules; shares are of words or characters of a line or a document."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_separator_percent: int = 20  # words of a line that are only separators
    max_symbol_percent: int = 12  # characters of a line from #*$%&|<>
    max_shout_percent: int = 40  # words of a line that end in two or more ! or ?
    short_line_words: int = 3  # an unclosed line of so few words is a heading or a menu entry
    min_kept_percent: int = 50  # of a document's words


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of text are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more."""

    def covered(ws: Column) -> Column:
        hashes = F.transform(
            F.when(F.size(ws) >= 3, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)),
        )
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(spread(h)))

    def spread(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(
            ordered,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        # each start covers three words, or as many as lie before the next start
        return let(
            F.sort_array(starts),
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x)),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    return let(words, covered)


def judged(line: Column, cfg: QualityConfig) -> Column:
    """(line, words, bad): the words of a line, and whether it breaks a rule; lines without words break none."""

    def rules(ws: Column) -> Column:
        n = F.size(ws)
        separators = F.size(F.filter(ws, lambda w: w.isin("|", "»", "«", "•", "·", ">", "<", "-", "–", "/", "::")))
        shouts = F.size(F.filter(ws, lambda w: w.rlike(r"[!?]{2,}$")))
        symbols = count_chars(line, "#*$%&|<>")
        bad = (
            (100 * separators > cfg.max_separator_percent * n)
            | (100 * symbols > cfg.max_symbol_percent * F.length(line))
            | (100 * shouts > cfg.max_shout_percent * n)
            | ((n <= cfg.short_line_words) & ~line.rlike(CLOSED))
            | ((n <= 30) & line.rlike(BOILERPLATE))
        )
        return F.struct(line.alias("line"), ws.alias("words"), ((n > 0) & bad).alias("bad"))

    return let(words_of(line), rules)


def verdict(text: Column, cfg: QualityConfig) -> Column:
    """A struct of ADDED for a text, in one pass over its lines."""

    def counted(lines: Column) -> Column:
        failed = F.filter(lines, lambda x: x["bad"])
        wordy = F.transform(F.filter(lines, lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
        words = F.flatten(F.transform(lines, lambda x: x["words"]))
        lost = F.aggregate(F.transform(failed, lambda x: F.size(x["words"]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.struct(
            let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeat_words(ws).cast("long").alias("again"))).alias("words"),
            let(wordy, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct"))).alias("lines"),
            F.size(failed).cast("long").alias("failed"),
            lost.alias("lost"),
            F.array_join(F.transform(F.filter(lines, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("cleaned"),
        )

    def judge(c: Column) -> Column:
        n, again = c["words"]["n"], c["words"]["again"]
        base_failed = (n < cfg.min_words) | (100 * again > cfg.max_repeat_percent * n)
        kept = ~base_failed & (100 * (n - c["lost"]) >= cfg.min_kept_percent * n)
        values = [
            n, F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"), count_chars(text, "#*$%&|<>").cast("long"),
            c["lines"]["n"] - c["lines"]["distinct"], again, base_failed, c["lines"]["n"], c["failed"], n - c["lost"], kept, c["cleaned"],
        ]
        return F.struct(*[v.alias(name) for name, v in zip(ADDED, values, strict=True)])

    return let(let(F.transform(F.split(text, "\n"), lambda x: judged(x, cfg)), counted), judge)


def quality_rules(docs: DataFrame, cfg: QualityConfig = QualityConfig(), text_col: str = "text") -> DataFrame:
    """docs with the counts, the line rules' outcome, the text ``cleaned`` of failing lines and the verdict ``kept`` added."""
    base = without(docs, ADDED)
    # a generator of one row, so that the verdict is computed once whatever is then asked of it
    return docs.select(*[F.col(f"`{c}`") for c in base.columns], F.inline(F.array(verdict(F.coalesce(F.col(text_col), F.lit("")), cfg))))


def clean(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that the rules keep, all columns as they are but for the text, which has lost its failing lines."""
    verdicts = F.array(verdict(F.coalesce(F.col("text"), F.lit("")), cfg))
    # within the generator, as a filter behind it would be moved in front and judge every text a second time
    out = packed_up(docs, "text").select("_in", F.inline(F.filter(verdicts, lambda v: v["kept"])))
    return unpacked(out, docs.columns, text=F.col("cleaned"))
