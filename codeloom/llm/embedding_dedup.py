"""Near-duplicate embeddings through a pivot-permutation index.

Reference points (pivots) are chosen from a bounded sample of the vectors, none
close to another. A vector is described by its nearest pivots in order and stands in
the inverted lists of the first few of them. Two vectors of a list that share
enough of their nearest pivots are verified: first by their vectors rounded to bytes,
with a bound on what the rounding can change, and, where that leaves the threshold
open, by the cosine in double precision.

Lists hold ids, pivots and rounded vectors, less than half the size of single floats. They are cut
into blocks of a fixed number of vectors and every two blocks of a list are a group
of their own, so that a list of any length spreads over many bounded tasks. A pair
counts in the first list it shares and nowhere else. A group hands on a row per
vector, with its number of links and the vector its links lead to, not a row per link.
Equal vectors are described once, with a count. The number of pivots grows with
the square root of the number of vectors, up to ``MOST_PIVOTS``; the more pivots, the
more lists a vector stands in (``number_of_lists``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, components, join_unique

THRESHOLD = 0.9
# Nearest pivots that describe a vector, and how many of them two similar vectors share.
NEAREST, SHARED = 16, 2
# Lists a vector stands in among the fewest pivots; see number_of_lists.
LISTS = 6
FEWEST_PIVOTS, MOST_PIVOTS = 64, 32768
# Cosine above which two pivots would tell the same.
TOO_CLOSE = 0.7
BLOCK = 4096


def unit_vector(values) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or not finite throughout."""
    if values is None or len(values) == 0 or any(v is None for v in values):
        return None
    v = np.asarray(values, "f8")
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top  # neither overflow nor underflow of the squares
    return v / np.sqrt(v @ v)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vector of floats is handed on as it is, half as long as its unit vector, which ``_matrix`` makes again."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.string()), ("vector", pa.binary()), ("dim", pa.int32())])
    for batch in batches:
        floats = pa.types.is_float32(batch.column(1).type.value_type)
        ids, keys, vectors, dims = batch.column(0).to_pylist(), [], [], []
        for values in batch.column(1):
            v = unit_vector(values.as_py())
            data = None if v is None else (v + 0.0).astype("<f8").tobytes()
            keys.append(None if data is None else hashlib.sha1(data).hexdigest())
            vectors.append(np.asarray(values.as_py(), "<f4").tobytes() if floats and data is not None else data)
            dims.append(0 if v is None else len(v))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(vectors, pa.binary()), pa.array(dims, pa.int32())], schema=schema)


def number_of_pivots(n: int) -> int:
    return int(min(max(4 * n ** 0.5, FEWEST_PIVOTS), MOST_PIVOTS))


def number_of_lists(pivots: int) -> int:
    """Of how many of its nearest pivots a vector stands in the lists: ``LISTS``, and one more for every 4 times as many pivots.

    Keeps the recall at cosine 0.9 in 64 dimensions above 0.99 up to ``MOST_PIVOTS``.
    """
    return LISTS + max(math.ceil(math.log2(max(pivots, 1) / FEWEST_PIVOTS) / 2), 0)


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Up to ``wanted`` rows of the sample, in order, each with cosines below ``TOO_CLOSE`` to those before."""
    chosen = np.empty((wanted, sample.shape[1]))
    n = 0
    for v in sample:
        if not n or (chosen[:n] @ v).max() < TOO_CLOSE:
            chosen[n] = v
            n += 1
            if n == wanted:
                break
    return chosen[:n]


def nearest_pivots(units: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first; ties go to the smaller number."""
    k = min(nearest, len(pivots))
    near = units @ pivots.T
    some = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(units), 1))
    some.sort(axis=1)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1).astype("i4")


def _matrix(column, dim: int) -> np.ndarray:
    """Unit vectors in double precision of what ``_units`` gave."""
    data = b"".join(column)
    if len(data) == 8 * dim * len(column):
        return np.frombuffer(data, "<f8").reshape(-1, dim)
    rows = np.frombuffer(data, "<f4").reshape(-1, dim).astype("f8")
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def rounded(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as bytes with a scale each, and the length of what rounding took away."""
    scale = (np.abs(units).max(axis=1) / 126.9).astype("f4")
    codes = np.rint(units / scale[:, None]).astype("i1")
    off = units - codes * scale[:, None].astype("f8")
    return codes, scale, np.sqrt(np.einsum("ij,ij->i", off, off))


def _entry(dim: int, nearest: int) -> np.dtype:
    """What a list holds of a vector besides its id."""
    return np.dtype([("near", "<u2", (nearest,)), ("code", "i1", (dim,)), ("scale", "<f4"), ("off", "<f4"), ("n", "<u4")])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n things that links (a, b) connect each one to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def link_group(ids: np.ndarray, entries: np.ndarray, left: np.ndarray, right: np.ndarray, pivot: int, lists: int, shared: int, threshold: float):
    """Links between the vectors ``left`` and ``right`` of one list: ((id, id it leads to, rows linked), (id, id) left open).

    ``left`` is ``right`` for the pairs inside a block. Pairs that share fewer pivots, or
    a list that comes before this one, are left out.
    """
    codes, scale, off = entries["code"].astype("f4"), entries["scale"].astype("f8"), entries["off"].astype("f8")
    surely, maybe = [], []
    for at in range(0, len(left), 256):
        i = left[at:at + 256]
        about = (codes[i] @ codes[right].T) * scale[i][:, None] * scale[right][None, :]
        # What rounding and single precision can change.
        slack = off[i][:, None] * (1 + off[right])[None, :] + off[right][None, :] * (1 + off[i])[:, None] + 4e-6
        open_ = about + slack >= threshold
        if left is right:
            open_ &= i[:, None] < right[None, :]
        x, y = np.nonzero(open_)
        for part in range(0, len(x), 1 << 15):
            u, v = x[part:part + (1 << 15)], y[part:part + (1 << 15)]
            one, two = entries["near"][i[u]], entries["near"][right[v]]
            same = one[:, :, None] == two[:, None, :]
            first = np.where(same[:, :lists, :lists].any(axis=2), one[:, :lists].astype("i4"), np.iinfo("i4").max).min(axis=1)
            good = (same.any(axis=2).sum(axis=1) >= shared) & (first == pivot)
            sure = about[u, v] - slack[u, v] >= threshold
            surely.append(np.column_stack([i[u], right[v]])[good & sure])
            maybe.append(np.column_stack([i[u], right[v]])[good & ~sure])
    none = np.zeros((0, 2), "i8")
    surely, maybe = (np.concatenate([none, *found]) for found in (surely, maybe))
    a, b = surely.T
    n = entries["n"].astype("i8")
    linked = np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
    some = np.flatnonzero(linked)
    roots = _roots(len(ids), a, b)
    return np.column_stack([ids[some], ids[roots[some]], linked[some].astype("i8")]), ids[maybe]


def near_links(vectors: DataFrame, dim: int, scratch: Scratch, threshold: float, lists: int | None, shared: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) links that connect what pairs of at least that cosine connect, and (id, linked) rows to be added up.

    ``vectors`` has key, id, vector, n, all of length ``dim``; ids are distinct.
    """
    wanted = number_of_pivots(vectors.count())
    # A bounded sample: four candidates per pivot, in the order of their keys, which are hashes.
    sample = vectors.select("vector", "key").orderBy("key").limit(4 * wanted).collect()
    pivots = choose_pivots(_matrix([r["vector"] for r in sample], dim), wanted)
    lists = min(lists or number_of_lists(len(pivots)), len(pivots))
    nearest = min(max(NEAREST, lists), len(pivots))
    shared = min(shared, nearest)
    entry = _entry(dim, nearest)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 1024):
                part = rows.iloc[at:at + 1024]
                units = _matrix(part["vector"], dim)
                out = np.zeros(len(part), entry)
                out["near"] = nearest_pivots(units, pivots, nearest)
                out["code"], out["scale"], out["off"] = rounded(units)
                out["n"] = part["n"]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "entry": [row.tobytes() for row in out], "near": list(out["near"][:, :lists].astype("i4"))})

    described = scratch.keep(vectors.select("id", "n", "vector").mapInPandas(describe, "id long, entry binary, near array<int>"))
    # One number per pivot.
    counts = dict(map(tuple, described.select(F.explode("near").alias("p")).groupBy("p").count().collect()))
    sizes = np.zeros(len(pivots), "i8")
    sizes[list(counts)] = list(counts.values())
    blocks = np.maximum(-(-sizes // BLOCK), 1)
    block_of = lambda ids, n: (ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype("i8") % n

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector in the lists of its nearest pivots, once per pair of blocks its block is in."""
        for rows in batches:
            for at in range(0, len(rows), 512):
                part = rows.iloc[at:at + 512]
                pivot = np.stack(part["near"].to_list()).ravel().astype("i8")
                at_row = np.repeat(np.arange(len(part)), lists)
                ids = part["id"].to_numpy()[at_row]
                own = block_of(ids, blocks[pivot])
                times = blocks[pivot]
                ends = np.cumsum(times)
                other = np.arange(ends[-1]) - np.repeat(ends - times, times)
                own = np.repeat(own, times)
                group = np.repeat(pivot, times) << 32 | np.minimum(own, other) << 16 | np.maximum(own, other)
                yield pd.DataFrame({"group": group, "id": np.repeat(ids, times), "entry": part["entry"].to_numpy()[np.repeat(at_row, times)]})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["group"].iloc[0])
        pivot, one, two = group >> 32, group >> 16 & 0xFFFF, group & 0xFFFF
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        entries = np.frombuffer(b"".join(rows["entry"]), entry)
        own = block_of(ids, blocks[pivot])
        left = np.flatnonzero(own == one)
        links, left_open = link_group(ids, entries, left, left if one == two else np.flatnonzero(own == two), pivot, lists, shared, threshold)
        return pd.DataFrame({
            "a": np.r_[links[:, 0], left_open[:, 0]], "b": np.r_[links[:, 1], left_open[:, 1]],
            "linked": np.r_[links[:, 2], np.zeros(len(left_open), "i8")]})

    placed = described.mapInPandas(place, "group long, id long, entry binary")
    found = scratch.keep(placed.groupBy("group").applyInPandas(compare, "a long, b long, linked long"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 1024):
                part = rows.iloc[at:at + 1024]
                cosine = np.einsum("ij,ij->i", _matrix(part["vector_a"], dim), _matrix(part["vector_b"], dim))
                yield part.loc[cosine >= threshold, ["a", "b", "n_a", "n_b"]]

    of = lambda end: vectors.select(F.col("id").alias(end), F.col("vector").alias(f"vector_{end}"), F.col("n").alias(f"n_{end}"))
    verified = scratch.keep(found.filter("linked = 0").select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInPandas(
        verify, "a long, b long, n_a long, n_b long"))
    links = found.filter("linked > 0 and a <> b").select("a", "b").unionByName(verified.select("a", "b"))
    linked = found.filter("linked > 0").select(F.col("a").alias("id"), "linked").unionByName(
        verified.select(F.col("a").alias("id"), F.col("n_b").alias("linked"))).unionByName(
        verified.select(F.col("b").alias("id"), F.col("n_a").alias("linked")))
    return links, linked


def near_duplicates(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
    lists: int | None = None, shared: int = SHARED,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; ids are integers.

    ``n_links`` counts the other rows whose vector has at least that cosine, copies
    included; ``component_id`` is the smallest id reachable by links, ``kept`` whether
    that is the own id. A vector that is null, empty, zero or not finite throughout
    links with nothing, and neither do vectors of different lengths. A row with a
    null id has a null component unless links reach an id. An empty table gives no rows.
    ``lists`` follows the number of pivots unless given.
    """
    scratch = Scratch(embeddings.sparkSession, "embeddings")
    ddl = "id long, key string, vector binary, dim int"
    units = scratch.keep(embeddings.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(_units, ddl))
    # Numbered as they are written: two vectors never share a number.
    classes = scratch.keep(
        units.filter("key is not null").groupBy("key", "dim").agg(F.min("id").alias("first"), F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("n"))
        .withColumn("id", F.monotonically_increasing_id()))
    links = linked = None
    for dim in sorted(r[0] for r in classes.select("dim").distinct().collect()):
        found = near_links(classes.filter(F.col("dim") == dim).select("key", "id", "n", "vector"), dim, scratch, threshold, lists, shared)
        links, linked = found if links is None else (links.unionByName(found[0]), linked.unionByName(found[1]))
    alone = lambda rows: rows.select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    if links is None:
        return alone(units)
    degree = linked.groupBy("id").agg(F.sum("linked").alias("linked"))
    roots = scratch.keep(components(links, scratch).select(F.col("node").alias("id"), "root"))
    reached = scratch.keep(classes.select("id", "key", "first", "n").join(roots.hint("merge"), "id"))
    least = scratch.keep(reached.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")))
    named = join_unique(reached, least, "root", "members").select("id", "key", "n", "component_id").unionByName(
        classes.join(roots.select("id").hint("merge"), "id", "left_anti").select("id", "key", "n", F.col("first").alias("component_id")))
    described = scratch.keep(named.join(degree.hint("merge"), "id", "left").select(
        "key", "n", "component_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    rows = join_unique(units.filter("key is not null").select("id", "key"), described, "key", "n")
    return rows.select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")).unionByName(alone(units.filter("key is null")))
