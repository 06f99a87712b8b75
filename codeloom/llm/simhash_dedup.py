"""Near-duplicate documents by SimHash, found with covering locality-sensitive hashing.

A document's fingerprint has a bit set if it is set in over half of the hashes
of its word shingles. Two fingerprints link if they differ in at most ``radius``
bits.

Every bit position gets a non-zero vector of ``radius + 1`` binary digits, and
every non-zero vector v of that length one table, whose mask holds the positions
whose vector has an odd inner product with v. The positions in which two linked
fingerprints differ are at most ``radius`` vectors; some v is orthogonal to all of
them, and in that table the two agree on the whole mask. So every pair within the
radius shares a bucket in some table: nothing within the radius is missed.

Inside a bucket of few fingerprints the pairs are compared. In a larger bucket
each fingerprint is written under every point it can meet another one halfway
at (half the radius away, on the bits outside the mask); all that share such a
point are within the radius, and are linked to the smallest of them. That is
linear in the bucket's size, spreads over as many tasks as there are points, and
yields the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, components, fresh, join_unique

RADIUS = 4
SHINGLE = 4
# Buckets of up to so many fingerprints are compared pair by pair, larger ones by meeting points.
PAIRS_UP_TO = 32
_ROWS_AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits as a signed integer; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash_of(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist())
        hashes = [hash_of(joined[a:b], 42) for a, b in spans]
    packed = np.array(hashes, dtype="<u8").view("u1").reshape(-1, 8)
    votes = np.zeros(64, "i8")
    for at in range(0, len(packed), _ROWS_AT_ONCE):
        votes += np.unpackbits(packed[at:at + _ROWS_AT_ONCE], axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(votes * 2 > len(packed), bitorder="little").view("<i8")[0])


def fingerprints(column, shingle: int = SHINGLE):
    """Column of fingerprints of a text column."""
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(column)


def masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask (signed) per table."""
    vectors = (1 << (radius + 1)) - 1
    owner = [i % vectors + 1 for i in range(64)]
    unsigned = [sum(1 << i for i in range(64) if bin(owner[i] & v).count("1") % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def _flips(mask: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All ways to flip up to ``most`` bits outside the mask, and how many each flips."""
    free = [i for i in range(64) if not mask >> i & 1]
    ways = [(sum(1 << i for i in c), n) for n in range(most + 1) for c in combinations(free, n)]
    return np.array([w for w, _ in ways], dtype="u8").view("i8"), np.array([n for _, n in ways], dtype="i4")


def near_links(points: DataFrame, scratch: Scratch, radius: int = RADIUS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of all pairs within ``radius``."""
    tables = masks(radius)
    entries = points.select(
        "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in tables))).alias("t", "key"))
    buckets = entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = scratch.keep(entries.join(buckets.hint("merge"), ["t", "key"]))

    few = shared.filter(F.col("n") <= pairs_up_to)
    left = few.select("t", "key", F.col("fp").alias("a"))
    right = few.select(F.col("t").alias("_t"), F.col("key").alias("_key"), F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.slice(F.array(*(F.lit(m) for m in tables)), F.lit(1), F.col("t"))
    met_before = F.exists(earlier, lambda m: m.bitwiseAND(differ) == 0)
    pairs = left.join(
        right,
        (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b"))
        & (F.bit_count(differ) <= radius) & ~met_before,
    ).select("a", "b")

    outer, inner = (radius + 1) // 2, radius // 2

    def meeting_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = {}
        for rows in batches:
            for t, own in rows.groupby("t", sort=False):
                if t not in flips:
                    flips[t] = _flips(tables[t], outer)
                ways, counts = flips[t]
                for at in range(0, len(own), 512):
                    fps = own["fp"].to_numpy()[at:at + 512]
                    yield pd.DataFrame({
                        "t": np.full(len(fps) * len(ways), t, "i4"), "point": (fps[:, None] ^ ways[None, :]).ravel(),
                        "fp": np.repeat(fps, len(ways)), "inner": np.tile(counts <= inner, len(fps)),
                    })

    many = shared.filter(F.col("n") > pairs_up_to).select("t", "fp")
    entries_met = many.count()
    if not entries_met:
        return pairs
    # Entries of one bucket lie together after the join; spread them before each becomes hundreds of rows, by number, as few bytes
    # would be put together again.
    spread = max(points.sparkSession.sparkContext.defaultParallelism, -(-entries_met // 50_000))
    met = many.repartition(spread, "fp").mapInPandas(meeting_points, "t int, point long, fp long, inner boolean")
    hubs = met.filter("inner").groupBy("t", "point").agg(F.min("fp").alias("hub"))
    through = met.join(hubs.hint("merge"), ["t", "point"]).filter("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.unionByName(through.distinct())


def _groups(prints: DataFrame, id_col: str, scratch: Scratch, radius: int) -> DataFrame:
    """(fp, first, n): for each fingerprint the smallest (id, fp) of its component, ids before null, and its number of rows."""
    points = scratch.keep(prints.groupBy("fp").agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n")))
    found = scratch.keep(components_of(points, scratch, radius))
    own = F.struct(F.col("id").isNull().alias("absent"), "id", "fp")
    linked = scratch.keep(points.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp"))
    first = scratch.keep(linked.groupBy("root").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("members")))
    alone = points.join(found.select(F.col("node").alias("fp")).hint("merge"), "fp", "left_anti").select("fp", own.alias("first"), "n")
    return scratch.keep(join_unique(linked, first, "root", "members").select("fp", "first", "n").unionByName(alone))


def components_of(points: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    return components(near_links(points, scratch, radius), scratch)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """(id, fingerprint, component_id) per document.

    ``fingerprint`` is 16 hexadecimal digits, ``component_id`` the smallest id that
    links reach, the own included. A null or empty text has fingerprint zero and
    links like any other; a repeated row is returned as often as it comes; a null id
    is returned with the component of its text and never names one unless the
    component has no other id (then it is null). An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(docs.select(F.col(id_col), fingerprints(F.col(text_col), shingle).alias("fp")))
    groups = _groups(prints, id_col, scratch, radius)
    return join_unique(prints, groups, "fp", "n").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"))


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one: that with the smallest id.

    All columns stay as they are. Of rows with the same id in one component a single
    one stays; a component whose ids are all null keeps one of its rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fp = fresh(docs, "fp")
    marked = scratch.keep(docs.withColumn(fp, fingerprints(F.col(text_col), shingle)))
    groups = _groups(marked.select(F.col(id_col), F.col(fp).alias("fp")), id_col, scratch, radius)
    of, first = fresh(marked, "of"), fresh(marked, "first")
    keepers = groups.filter(F.col("fp") == F.col("first.fp")).select(F.col("fp").alias(of), F.col("first.id").alias(first))
    kept = marked.join(keepers, (F.col(fp) == F.col(of)) & F.col(id_col).eqNullSafe(F.col(first)))
    return kept.select(*marked.columns).dropDuplicates([id_col, fp]).drop(fp)
