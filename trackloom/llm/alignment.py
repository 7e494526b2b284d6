"""Which tokens of two tokenizers cover the same bytes.

Each text, with a space before it, is cut into units that neither tokenizer looks across: a word with
the space or line break before it, where white space is regular, and else the text itself, in chunks
if it is long. A Python task works through blocks of texts: every distinct unit of a block is tokenised
once, its tokens are cut into groups at the ends that both sides have, and each end of a token on
either side closes exactly one stretch that one A and one B token share, which is a link. It sends a few
small rows for each block, which bear its number: its distinct id pairs with how many links hold them, and of
every document its groups and its links as places among those pairs.

Spark adds the pairs of all blocks up, finds the highest count of each B id, and joins the counts with
the pairs of each block, which hold a pair once however frequent it is, so no key is hot. A
document's sums (aggregate) run over its links, whose counts its block now holds.

Defined cases: a null or empty text, or one whose joined token bytes on either side are not
space+text (characters that a tokenizer rewrites, bytes that are not UTF-8), has no tokens,
groups or links; texts of any length are encoded whole; repeated rows are rows of their own
and each counts its links; a null doc_id is carried along; pairs that tie for a B id's highest
count are all best; an empty table gives an empty result; other columns of the input may have any names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import Scratch, release, sliced, without
from .packing import WordTable
from .shingles import mix, word_bounds, word_hashes

#: Of no effect any more: nothing is joined by groups. tests/llm/test_alignment.py sets them.
FREQUENT = 100_000
KEY_CHARS = 100
#: Characters of a block of texts.
BLOCK = 1 << 19
#: Links, and pairs, of a row that a block is sent in; a document's links stay in one row.
PIECE = 1 << 13
#: A unit starts at a lone space or line break between other characters.
UNIT = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S*)*|\s+")
#: What makes a text irregular: white space of another kind, in a run, or at an end. The units of other texts are words.
ODD = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z")
BAD = 0xFFFFFFFF
COUNTED = ["n_a", "n_b", "n_groups", "n_links"]
ADDED = [*COUNTED, "n_best", "count_sum"]


@dataclass(frozen=True)
class AlignConfig:
    """byte_bpe: a byte-level vocabulary (A); piece: a sentencepiece model with byte fallback (B); both are files that every executor has."""

    byte_bpe: str
    piece: str


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_bpe(path: str):
    """(encoder of many texts, bytes of each id) of a byte-level vocabulary.

    If its ids follow the order of its merges it is encoded by ranks, which is several times faster and holds less.
    """
    import public_tokenizers
    import tiktoken

    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    vocab, cut = d["model"]["vocab"], d["pre_tokenizer"] or {}
    whole = vocab | {t["content"]: t["id"] for t in d["added_tokens"]}
    token_bytes = [b""] * (max(whole.values()) + 1)
    for token, i in whole.items():
        token_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in d["model"]["merges"]]
    in_order = sorted(vocab.get(c, -1) for c in letters) + merged == list(range(256 + len(merged)))
    if in_order and not d["normalizer"] and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex"):
        ranks = {token_bytes[i]: i for i in range(256 + len(merged))}
        encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return (lambda texts: [encode(t) for t in texts]), token_bytes
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return (lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]), token_bytes


class Side(WordTable):
    """Token ids of each word seen with the space or line break before it, by its 64-bit hash; BAD if they don't join to the word."""

    LIMIT = 500_000

    def __init__(self, encode, token_bytes: list[bytes]):
        self.whole, self.token_bytes = encode, token_bytes
        self.length = np.array([len(t) for t in token_bytes], np.int64)
        self.names = pa.array(np.arange(len(token_bytes))).cast(pa.string())
        self.clear()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [ids if self.joins(w, ids) else [BAD] for w, ids in zip(words, self.whole(words), strict=True)]

    def joins(self, text: str, ids: list[int]) -> bool:
        return b"".join([self.token_bytes[i] for i in ids]) == text.encode()


class Units:
    """Both tokenizers, by units of a text that neither looks across."""

    CHUNK = 1 << 16

    def __init__(self, cfg: AlignConfig):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        encode_a, a_bytes = byte_bpe(cfg.byte_bpe)
        piece = sentencepiece.SentencePieceProcessor(model_file=cfg.piece)
        pieces = [piece.id_to_piece(i) for i in range(piece.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        blank = piece.piece_to_id("▁")

        def encode_b(texts: list[str]) -> list[list[int]]:
            """The model puts a space before a text: the one that is there, or one that goes again."""
            out = piece.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
            return [ids[1:] if t[0] != " " and ids[:1] == [blank] else ids for t, ids in zip(texts, out, strict=True)]

        self.sides = Side(encode_a, a_bytes), Side(encode_b, b_bytes)
        # units are exact only if no piece reaches across the place of a cut
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def forget(self) -> None:
        """Give back what the words seen so far take."""
        for side in self.sides:
            side.clear()
        release()

    def chunks(self, text: str) -> list[str]:
        """A text with its space, cut between units into chunks of about CHUNK characters."""
        if not self.cuts or len(text) < self.CHUNK:
            return [" " + text]
        out, held = [[]], 0
        for u in UNIT.findall(" " + text):
            if held and held + len(u) > self.CHUNK:
                out.append([])
                held = 0
            out[-1].append(u)
            held += len(u)
        return ["".join(x) for x in out]

    def chunked(self, text: str) -> list[list[list[int]]] | None:
        """The ids of each chunk of an irregular text, on both sides."""
        chunks = self.chunks(text)
        out = [side.whole(chunks) for side in self.sides]
        return out if all(all(map(side.joins, chunks, ids)) for side, ids in zip(self.sides, out, strict=True)) else None

    def block(self, texts: list[str | None]) -> tuple[list, list[np.ndarray], list[np.ndarray]]:
        """What a block of texts consists of.

        [(ids, tokens a unit)] of A and B over the block's distinct units; the units of each text; how many A and B tokens it has.
        """
        regular = [bool(t) and self.cuts and not ODD.search(t) for t in texts]
        raws = [b" " + t.encode() if r else b"" for t, r in zip(texts, regular, strict=True)]
        raw = b"".join(raws) + b" "
        buf = np.frombuffer(raw, np.uint8)
        h, start = word_hashes(buf, lower=False)
        _, stop = word_bounds(buf)
        uniq, first, back = np.unique(mix(h ^ buf[start - 1]), return_index=True, return_inverse=True)
        word_at = lambda i: raw[start[first[i]] - 1 : stop[first[i]]].decode()
        found = [side.find(uniq, word_at) for side in self.sides]
        good = np.ones(len(uniq), bool)
        for side, (off, _) in zip(self.sides, found, strict=True):
            good &= side.flat[off] != BAD
        cut = np.searchsorted(start, np.cumsum([len(r) for r in raws])).tolist()
        of = [back[i:j] for i, j in zip([0, *cut[:-1]], cut, strict=True)]
        of = [u if good[u].all() else u[:0] for u in of]
        sides = []
        for side, (off, n) in zip(self.sides, found, strict=True):
            n = np.where(good, n, 0)
            sides.append([[side.flat[np.repeat(off - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)], [n]])
        units = len(uniq)
        for k, (t, r) in enumerate(zip(texts, regular, strict=True)):
            if t and not r and (both := self.chunked(t)):
                of[k] = np.arange(units, units + len(both[0]))
                units += len(both[0])
                for (ids, counts), chunks in zip(sides, both, strict=True):
                    ids.extend(np.array(x, np.int64) for x in chunks)
                    counts.append(np.array([len(x) for x in chunks], np.int64))
        sides = [(np.concatenate(ids), np.concatenate(counts)) for ids, counts in sides]
        return sides, of, [np.array([n[u].sum() for u in of], np.int64) for _, n in sides]


@cache
def _units(cfg: AlignConfig) -> Units:
    return Units(cfg)


def _lists(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


@dataclass(frozen=True)
class Aligned:
    """Groups of each unit as ``a1,a2|b1;a3|b2`` (empty without tokens) and how many; its links, unit after unit, as a_id << 32 | b_id, and how many."""

    texts: pa.Array
    n_groups: np.ndarray
    links: np.ndarray
    n_links: np.ndarray


def align_units(sides: list[tuple[np.ndarray, np.ndarray]], vocabularies: tuple[Side, Side]) -> Aligned:
    """sides: (ids, tokens a unit) of A and B.

    Both sides of a unit join to the same bytes, so offsets run on over all units and every unit ends at a common end.
    """
    ends = [np.cumsum(side.length[ids]) for (ids, _), side in zip(sides, vocabularies, strict=True)]
    stop = np.concatenate([[0], ends[0]])[np.cumsum(sides[0][1])]  # of each unit
    common, either = np.intersect1d(*ends, assume_unique=True), np.union1d(*ends)
    texts = []
    for (ids, _), side, end in zip(sides, vocabularies, ends, strict=True):
        cuts = np.concatenate([[0], np.searchsorted(end, common) + 1]).astype(np.int32)
        texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), side.names.take(pa.array(ids))), ","))
    n_groups, n_links = (np.diff(np.searchsorted(x, stop, side="right"), prepend=0) for x in (common, either))
    joined = pc.binary_join(_lists(pc.binary_join_element_wise(*texts, "|"), n_groups), ";")
    a, b = (ids[np.searchsorted(end, either)] for (ids, _), end in zip(sides, ends, strict=True))
    return Aligned(joined, n_groups, a << 32 | b, n_links)


def _decoded(raw: pa.Scalar) -> str | None:
    try:
        return raw.as_py().decode() if raw.is_valid else None
    except UnicodeDecodeError:
        return None


def block_row(units: Units, ins: list[pa.Array], texts: list[str | None]) -> pa.RecordBatch:
    """One row for a block of texts, its documents with their columns ``ins``."""
    sides, of, tokens = units.block(texts)
    made = align_units(sides, units.sides)
    used, n_units = np.concatenate([*of, np.empty(0, np.int64)]).astype(np.int64), np.array([len(u) for u in of])
    n = made.n_links[used]
    pairs, place = np.unique(made.links, return_inverse=True)
    links = place.astype(np.int32)[np.repeat((np.cumsum(made.n_links) - made.n_links)[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    n_groups, n_links = (np.diff(np.concatenate([[0], np.cumsum(x[used])])[np.cumsum(n_units)], prepend=0) for x in (made.n_groups, made.n_links))
    groups = pc.binary_join(_lists(made.texts.take(pa.array(used)), n_units), ";")
    docs = pa.StructArray.from_arrays([pa.concat_arrays(ins), *map(pa.array, (*tokens, n_groups, n_links)), _lists(links, n_links), groups], ["_in", *COUNTED, "links", "groups"])
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([one(docs), one(pa.array(pairs)), one(pa.array(np.bincount(links, minlength=len(pairs))))], names=["docs", "pairs", "times"])


def pieces(block: int, row: pa.RecordBatch) -> pa.RecordBatch:
    """A block's row as rows of about PIECE links and PIECE pairs: (_block, docs, start, pairs, times), start being the place of a row's first pair."""
    docs, pairs, times = (row.column(c).flatten() for c in ("docs", "pairs", "times"))
    size = np.cumsum(np.asarray(docs.field("n_links")) + 64) // PIECE  # never falls
    n = int(max(size[-1] + 1, -(-len(pairs) // PIECE)))
    cut = lambda at, x: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), x)
    at, start = np.searchsorted(size, np.arange(n + 1)), np.minimum(np.arange(n + 1) * PIECE, len(pairs))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), cut(at, docs), pa.array(start[:-1]), cut(start, pairs), cut(start, times)], names=["_block", "docs", "start", "pairs", "times"])


def _blocks(docs: DataFrame, cfg: AlignConfig, text: str, keep: list[str]) -> DataFrame:
    """(_block, docs, start, pairs, times): rows of a block of texts, its documents, the distinct pairs of its links, how many links hold each.

    A block is several rows, as rows of megabytes fill the memory of whatever reads, writes or sorts them by the row.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_in"), F.col(f"`{text}`").cast("binary").alias("_text"))
    longs, ints = ArrayType(LongType(), False), ArrayType(IntegerType(), False)
    doc = StructType([rows.schema["_in"], *[StructField(c, LongType()) for c in COUNTED], StructField("links", ints), StructField("groups", StringType())])
    schema = StructType([StructField("_block", LongType()), StructField("docs", ArrayType(doc, False)), StructField("start", LongType()), StructField("pairs", longs), StructField("times", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ins, texts, size = TaskContext.get().partitionId() << 33, [], [], 0
        for b in sliced(batches, 64):
            for k, x in enumerate(b.column("_text")):
                ins.append(b.column("_in").slice(k, 1))
                texts.append(_decoded(x))
                size += len(texts[-1] or "") + 64
                if size > BLOCK:
                    yield pieces(block, block_row(_units(cfg), ins, texts))
                    block, ins, texts, size = block + 1, [], [], 0
        if texts:
            yield pieces(block, block_row(_units(cfg), ins, texts))
        ins, texts = [], []
        _units(cfg).forget()  # the worker lives on beside the stages that follow

    return rows.mapInArrow(run, schema)


def link_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count): how many links of the corpus hold the pair, a_id << 32 | b_id."""
    rows = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    return rows.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))


def block_scores(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """(_block, scores): the count of every pair of a block, in order, below zero if no pair of the B id has more links."""
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id")
    most = counts.groupBy(b_id).agg(F.max("count").alias("most"))  # one row per id of a vocabulary
    score = F.when(F.col("count") == F.col("most"), -F.col("count")).otherwise(F.col("count")).alias("score")
    known = counts.select("pair", "count", b_id).join(F.broadcast(most), "b_id").select("pair", score)
    rows = blocks.select("_block", "start", F.posexplode("pairs").alias("at", "pair")).select("_block", (F.col("start") + F.col("at")).alias("at"), "pair").join(known, "pair")
    return rows.groupBy("_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "score"))), lambda s: s["score"]).alias("scores"))


def align(docs: DataFrame, cfg: AlignConfig, keep: list[str] | None = None, text: str = "text", derive: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A row for each document: its columns in ``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and the groups.

    The groups are one string in decimal ids, ``a1,a2|b1;a3|b2``, as column ``groups``, or what ``derive`` makes of that string.
    keep: all columns but those called like an added one, unless given.
    """
    scratch = Scratch(docs.sparkSession)
    derive = {"groups": lambda g: g} if derive is None else derive
    keep = keep if keep is not None else without(docs, [*ADDED, *derive]).columns
    blocks = _blocks(docs, cfg, text, keep)
    made = F.transform("docs", lambda d: F.struct(*[d[c].alias(c) for c in ("_in", *COUNTED, "links")], F.struct(*[f(d["groups"]).alias(c) for c, f in derive.items()], F.lit(0).alias("_")).alias("made")))
    blocks = scratch.save(blocks.select("_block", made.alias("docs"), "start", "pairs", "times"))
    scores = block_scores(blocks, scratch.save(link_counts(blocks)))
    total = lambda f, name: F.aggregate(F.col("d")["links"], F.lit(0).cast("long"), lambda s, i: s + f(F.get("scores", i))).alias(name)
    out = blocks.select("_block", F.explode("docs").alias("d")).join(scores, "_block", "left").select("d", total(lambda x: F.shiftrightunsigned(x, 63), "n_best"), total(F.abs, "count_sum"))
    return out.select(*[F.col("d")["_in"][c].alias(c) for c in keep], *[f"d.{c}" for c in COUNTED], "n_best", "count_sum", *[F.col("d")["made"][c].alias(c) for c in derive])
