"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius of each.

A text's terms are its runs of ``TERM`` words (all of them together, if fewer);
a term weighs one plus the logarithm of its count. The 64-bit hash of a term votes
with its weight for the bits it has set and against the others; the fingerprint
has the bits with a positive sum. Word hashes are polynomials over the UTF-8 bytes,
taken for all words of a text at once.

To find what lies within a radius, the 64 bits are cut into blocks. A pair that
differs in at most ``radius`` bits agrees in at least ``blocks - radius`` blocks, so
there is one table for each choice of that many blocks, keyed by the bits of the
chosen blocks; equal keys are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch

TERM = 2
RADIUS, BLOCKS = 3, 6
_ROWS_AT_ONCE = 1 << 14
# Odd multipliers of the hashes, and the inverse of the first one modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_BACK = pow(_BASE, -1, 1 << 64)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    known = _powers.get(name)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, "u8")
        known[0] = 1
        _powers[name] = known = np.multiply.accumulate(known)
    return known[:n]


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


def term_hashes(text: str | None, term: int = TERM) -> np.ndarray:
    """Hashes of the terms of a text in order, repeats included."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "u1")
    word = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype("i1")))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, "u8")
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype("u8")
    sums = np.concatenate((np.zeros(1, "u8"), np.cumsum((lower + np.uint64(1)) * _power("up", _BASE, len(data)), dtype="u8")))
    words = _stirred((sums[ends] - sums[starts]) * _power("down", _BASE_BACK, len(data))[starts])
    n = min(term, len(words))
    terms = np.zeros(len(words) - n + 1, "u8")
    for k in range(n):
        terms = terms * np.uint64(_BASE) + words[k:k + len(terms)]
    return _stirred(terms)


def fingerprint(text: str | None, term: int = TERM) -> int:
    """64 bits as an unsigned integer; 0 for a text without words."""
    hashes, counts = np.unique(term_hashes(text, term), return_counts=True)
    weights = (1 + np.log(counts)).astype("f4")
    for_bit = np.zeros(64, "f8")
    for at in range(0, len(hashes), _ROWS_AT_ONCE):
        bits = np.unpackbits(hashes[at:at + _ROWS_AT_ONCE].astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        for_bit += weights[at:at + _ROWS_AT_ONCE] @ bits
    return int(np.packbits(for_bit * 2 > weights.sum(dtype="f8"), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def likeness(a: int, b: int) -> float:
    """1 less the share of bits in which two fingerprints differ."""
    return 1 - (a ^ b).bit_count() / 64


def _signed(fp: int) -> int:
    return fp - (1 << 64) if fp >> 63 else fp


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``after``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + after[:cut]


# One row per document; rows at the end of a partition wait for the beginning of the next.
_DDL = "part long, kind int, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long, text string"


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", term: int = TERM) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is taken from the next document.

    Columns: the id, ``n_chars``, ``edited_sha256``, ``fp`` and ``edited_fp`` and
    ``next_fp`` (signed longs). The next document is the one with the next smaller id,
    after the last the first; null ids come last, and rows with equal ids follow each
    other in the order they are read. A null text counts as an empty one; a single
    document is its own next; an empty table gives no rows.

    Rows are dealt by ranges of the id, so that neighbours are neighbours in a task;
    where two ranges meet, the two documents are joined afterwards.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    kind = docs.schema[id_col].dataType
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(kind)), ("part", pa.int64()), ("kind", pa.int32()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fp", pa.int64()), ("edited_fp", pa.int64()), ("next_fp", pa.int64()), ("text", pa.string())])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held = TaskContext.get().partitionId(), [], None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                fp = fingerprint(text, term)
                if held is None:
                    rows.append((None, part, 1, None, None, _signed(fp), None, None, text))
                else:
                    rows.append(_row(held[0], part, held[1], held[2], text, fp, term))
                held = (id_.as_py(), text, fp)
                if len(rows) >= 2048:
                    yield out()
                    rows.clear()
        if held is not None:
            rows.append((held[0], part, 2, None, None, _signed(held[2]), None, None, held[1]))
            yield out()

    columns = f"id {kind.simpleString()}, {_DDL}"
    passed = scratch.keep(dealt.mapInArrow(along, columns))
    heads = passed.filter("kind = 1").select(F.col("part").alias("at"), F.col("fp").alias("head_fp"), F.col("text").alias("head"))
    # As many numbers as there are partitions with rows.
    parts = sorted(r[0] for r in passed.filter("kind = 1").select("part").collect())
    whole = passed.filter("kind = 0")
    if parts:
        follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, at long")
        ends = passed.filter("kind = 2").join(follows, "part").join(heads, "at").select("id", "part", "text", "fp", "head", "head_fp")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    row = _row(r["id"], r["part"], r["text"], r["fp"] % (1 << 64), r["head"], r["head_fp"] % (1 << 64), term)
                    yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(row, schema)], schema=schema)

        whole = whole.unionByName(ends.mapInArrow(meet, columns))
    return whole.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def _row(id_, part: int, text: str, fp: int, after: str, after_fp: int, term: int) -> tuple:
    new = edited(text, after)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    new_fp = fp if new == text else fingerprint(new, term)
    return id_, part, 0, len(text), digest, _signed(fp), _signed(new_fp), _signed(after_fp), None


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """One signed 64-bit mask per table: every choice of ``blocks - radius`` of the blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(block[i] for i in choice)) for choice in combinations(range(blocks), blocks - radius)]


def within_radius(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, n_docs, n_within): distinct fingerprints, their documents, and the documents within the radius of each, its own included.

    ``prints`` has a column ``fp``. Copies meet as one fingerprint with a count.
    """
    tables = block_masks(radius, blocks)
    points = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n_docs"))
    keyed = points.select("fp", "n_docs", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in tables))).alias("t", "key"))
    other = keyed.select(F.col("t").alias("_t"), F.col("key").alias("_key"), F.col("fp").alias("_fp"), F.col("n_docs").alias("_n"))
    differ = F.col("fp").bitwiseXOR(F.col("_fp"))
    # A pair that agrees in several tables counts in the first of them.
    met_before = F.exists(F.slice(F.array(*(F.lit(m) for m in tables)), F.lit(1), F.col("t")), lambda m: m.bitwiseAND(differ) == 0)
    pairs = keyed.join(
        other,
        (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")) & (F.col("fp") != F.col("_fp"))
        & (F.bit_count(differ) <= radius) & ~met_before)
    others = pairs.groupBy("fp").agg(F.sum("_n").alias("near"))
    return points.join(others, "fp", "left").select("fp", "n_docs", (F.col("n_docs") + F.coalesce("near", F.lit(0))).alias("n_within"))
