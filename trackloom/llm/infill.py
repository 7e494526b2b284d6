"""Fill-in-the-middle documents, by bit-parallel work on big integers.

A text is one integer per class of bytes, a bit for each byte, made by translating its UTF-8
bytes to the digits 0 and 1. With L the letters and C the bytes that continue a character, a
unit (a run of letters, or any other character) starts wherever neither C nor ``L & (L >> 1)``
has a bit: a letter starts one only if the byte before it is none. The number of units is a
count of bits. The byte at which the k-th unit starts is found by halving: the count of the
upper half tells in which half it is, so all steps together read the text twice.

The two cuts come from the hash of the document's id, so any run and any cluster makes the
same documents. The output is cut from the text's bytes and is rebuilt from itself alone.

Defined cases: a null or empty text has no units and stays plain, as does a text that holds a
marker; a null doc_id hashes like an empty number; repeated rows are each transformed alike;
texts of any length are worked on whole, in memory of a few times their size; bytes that are not
UTF-8 count as characters unless they look like continuations, and are kept; an empty table gives
an empty result; columns of the input that are called like an added one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import packed_up, sliced, without

ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output binary"
LETTER = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))
CONTINUES = bytes(49 if 0x80 <= b < 0xC0 else 48 for b in range(256))


@dataclass(frozen=True)
class InfillConfig:
    """plain_percent: documents left as they are; spm_percent: of the others, those that give the suffix first; salt: hashed before the id."""

    plain_percent: int = 10
    spm_percent: int = 20
    salt: str = "1:"
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    @property
    def markers(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle


def bits(raw: bytes, digits: bytes) -> int:
    """An integer with a bit for each byte, the first byte's highest."""
    return int(raw.translate(digits) or b"0", 2)


def starts(raw: bytes) -> tuple[int, int]:
    """(bits where units start, bits where characters start)."""
    full = (1 << len(raw)) - 1
    chars = full ^ bits(raw, CONTINUES)
    letters = bits(raw, LETTER)
    return chars ^ (letters & (letters >> 1)), chars


def select(mask: int, width: int, rank: int) -> int:
    """How many bits stand before the one of this rank (from 0), counted from the highest of ``width``."""
    at = 0
    while width > 1:
        low = width // 2
        upper = mask >> low
        n = upper.bit_count()
        if rank < n:
            mask, width = upper, width - low
        else:
            rank -= n
            at += width - low
            mask, width = mask & ((1 << low) - 1), low
    return at


def transform(key: str, raw: bytes, cfg: InfillConfig = InfillConfig()) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    digest = hashlib.sha256(f"{cfg.salt}{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    units, chars = starts(raw)
    n = units.bit_count()
    if not raw or any(m in raw for m in cfg.markers) or h3 % 100 >= 100 - cfg.plain_percent:
        return n, "plain", None, None, raw
    size = len(raw)
    cuts = [size if k == n else select(units, size, k) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    before = [(chars >> (size - c)).bit_count() for c in cuts]
    prefix, middle, suffix = raw[: cuts[0]], raw[cuts[0] : cuts[1]], raw[cuts[1] :]
    if h4 % 100 < cfg.spm_percent:
        form, out = "spm", (cfg.suffix, suffix, cfg.prefix, prefix, cfg.middle, middle)
    else:
        form, out = "psm", (cfg.prefix, prefix, cfg.suffix, suffix, cfg.middle, middle)
    return n, form, before[0], before[1] - before[0], b"".join(out)


def fill_in_middle(docs: DataFrame, cfg: InfillConfig = InfillConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs and ADDED; output is the transformed text, byte for byte."""
    docs = without(docs, ADDED)
    rows = packed_up(docs).withColumn("_key", F.coalesce(F.col("_in")[key].cast("string"), F.lit(""))).withColumn("_text", F.col("_in")[text].cast("binary"))
    schema = StructType([rows.schema["_in"], *StructType.fromDDL(_SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for b in sliced(batches, 256):
            made = [transform(k, t or b"", cfg) for k, t in zip(b.column("_key").to_pylist(), b.column("_text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_in"), *[pa.array([m[i] for m in made], t) for i, t in enumerate(types)]], names=["_in", *ADDED])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("_in")[c].alias(c) for c in docs.columns], *[F.col(c).cast("string").alias(c) if c == "output" else F.col(c) for c in ADDED])


def restored(output: Column, form: Column, cfg: InfillConfig = InfillConfig()) -> Column:
    """The text, rebuilt from output and form, by bytes: no part of a transformed text holds a marker."""
    p, s, m = (x.decode() for x in cfg.markers)
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
