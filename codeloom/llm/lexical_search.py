"""The k best documents of every item by weighted shared terms, by dual-tree search.

Documents are read once into vectors over the terms of the items. In every task,
chunks of documents form a hierarchy, as the items do: rows close to each other in a
random projection share a leaf, and a node holds, per term, the largest value of any
row below it. The product of two nodes' maxima bounds the score of every document
below the one for every item below the other. Both hierarchies are searched together
from their roots; a pair whose bound lies below the weakest k-th score of its items
goes with all that is below it. Leaves that remain are scored in full. All arithmetic
after the weights is on 64-bit integers, so bounds and scores are exact and the result is
that of scoring everything.

Odd rows: null and blank texts and texts without a term have no terms: such documents
count for nothing, such items get no rows. Of items with the same id the one with
the greatest text counts; a null id is an id. Documents with the same id are documents of
their own; ids must be integers, and a null id (kept as the largest long) comes
last among equal scores. No documents or no items give no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch

BEST = 20
# Items searched for in one pass over the documents, by number and by bytes of text.
ITEMS_AT_ONCE, ITEM_BYTES_AT_ONCE = 8192, 1 << 24
# Documents of one hierarchy, by number and by vector entries.
_CHUNK, _CHUNK_ENTRIES = 8192, 1 << 21
_LEAF, _ITEM_LEAF, _FAN, _DIMENSIONS = 8, 1, 4, 4
_NO_ID = np.iinfo("i8").max
# Bytes that belong to a term stand for themselves, capitals for their small letters, all others for a blank.
_FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order: runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.translate(_FOLDED).split() if text else []


# Rows of sparse integer vectors and hierarchies over them


@dataclass
class Rows:
    """Sparse rows: those of ``columns`` and ``values`` from ``starts[i]`` to ``starts[i + 1]``; none is empty."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows, one after the other, and where each row begins among them."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends + sizes, sizes), ends - sizes

    def taken(self, rows: np.ndarray) -> Rows:
        at, begin = self.places(rows)
        return Rows(np.r_[begin, len(at)], self.columns[at], self.values[at])

    def products(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner product of some rows with every column of ``dense`` (terms, anything)."""
        at, begin = self.places(rows)
        return np.add.reduceat(self.values[at][:, None] * dense[self.columns[at]], begin, axis=0)


def _maxima(rows: Rows, group: np.ndarray, n_terms: int) -> Rows:
    """Per group of consecutive rows the largest value of each term."""
    key = np.repeat(group, np.diff(rows.starts)) * n_terms + rows.columns
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    owner, columns = np.divmod(key[begin], n_terms)
    return Rows(np.searchsorted(owner, np.arange(group[-1] + 2)), columns, np.maximum.reduceat(rows.values[order], begin))


def _near_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the points in which neighbours are close: halved along the widest dimension, again and again."""
    found, waiting = [], [np.arange(len(points))]
    while waiting:
        some = waiting.pop()
        if len(some) <= leaf:
            found.append(some)
            continue
        axis = np.ptp(points[some], axis=0).argmax()
        half = -(-len(some) // (2 * leaf)) * leaf  # whole leaves on the left
        parted = some[np.argpartition(points[some, axis], min(half, len(some) - 1))]
        waiting += [parted[half:], parted[:half]]
    return np.concatenate(found)


class Hierarchy:
    """Rows in an order of closeness, and levels of maxima over ever larger runs of them."""

    def __init__(self, rows: Rows, directions: np.ndarray, leaf: int):
        # Every term counts alike here: the frequent ones tell languages and subjects apart, rare ones are shared by few.
        points = np.add.reduceat(directions[rows.columns], rows.starts[:-1], axis=0) / np.sqrt(np.diff(rows.starts))[:, None]
        self.order = _near_order(points, leaf)
        self.rows, self.leaf = rows.taken(self.order), leaf
        self.levels = [_maxima(self.rows, np.arange(len(rows)) // leaf, len(directions))]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(_maxima(below, np.arange(len(below)) // _FAN, len(directions)))

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes one level down, or, from level 0, rows."""
        fan, n = (_FAN, len(self.levels[level - 1])) if level else (self.leaf, len(self.rows))
        at = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return at[at < n]


@dataclass
class Items:
    """What every task needs: the items' hierarchy, the projection of the terms, and statistics of the documents."""

    ids: list
    tree: Hierarchy
    directions: np.ndarray
    n_docs: int
    n_terms: int


def weight(n_docs: int, n_holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n_holding + 1)))


def build_items(ids: list, texts: list[list[bytes]], number: dict[bytes, int], holding: dict[int, int], n_docs: int, n_terms: int) -> Items:
    """Hierarchy of the items (none without terms); a row's value is the term's weight times its occurrences in the item."""
    weights = np.array([weight(n_docs, holding.get(i, 0)) for i in range(len(number))], "i8")
    counted = [Counter(words) for words in texts]
    columns = np.array([number[t] for c in counted for t in c], "i8")
    times = np.array([n for c in counted for n in c.values()], "i8")
    starts = np.r_[0, np.cumsum([len(c) for c in counted])]
    directions = np.random.default_rng(3).standard_normal((len(weights), _DIMENSIONS)).astype("f4")
    tree = Hierarchy(Rows(starts, columns, times * weights[columns]), directions, _ITEM_LEAF)
    return Items([ids[i] for i in tree.order], tree, directions, n_docs, n_terms)


class Search:
    """Running best documents of all items; ``add`` takes chunks of documents."""

    def __init__(self, items: Items, best: int = BEST):
        self.items, self.best = items, best
        n = len(items.tree.rows)
        self.scores = np.zeros((n, best), "i8")
        self.ids = np.full((n, best), _NO_ID)
        self.scored = 0  # pairs of a document and an item that were scored
        self._floors()

    def _floors(self) -> None:
        """The weakest k-th score below every node of the items' hierarchy."""
        floor = self.scores[:, -1]
        self.floors = []
        for fan in (_ITEM_LEAF, *(_FAN for _ in self.items.tree.levels[1:])):
            floor = np.minimum.reduceat(floor, np.arange(0, len(floor), fan))
            self.floors.append(floor)

    def add(self, ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray, columns: np.ndarray, times: np.ndarray) -> None:
        """Documents by id, number of terms, and occurrences of the items' terms."""
        some = np.flatnonzero(np.diff(starts))
        if not len(some):
            return
        items = self.items
        # Python's integers, as the product of a long text's terms and many documents can pass 64 bits.
        m = np.array([75 + 25 * n * items.n_docs // items.n_terms for n in lengths.tolist()], "i8")
        owner = np.repeat(np.arange(len(ids)), np.diff(starts))
        values = 1_000_000_000 * times // (1000 * times + 12 * m[owner])
        rows = Rows(np.r_[starts[some], starts[-1]], columns, values)
        docs = Hierarchy(rows, items.directions, _LEAF)
        ids = ids[some][docs.order]
        dense = np.zeros((len(items.directions), max(_FAN, _LEAF)), "i8")
        tree = items.tree

        def bounds(level: int, nodes: np.ndarray, item_level: int, item_nodes: np.ndarray) -> np.ndarray:
            """Bounds for pairs of some document nodes (columns) and item nodes (rows)."""
            at, begin = docs.levels[level].places(nodes)
            found = docs.levels[level].columns[at]
            dense[found, np.repeat(np.arange(len(nodes)), np.diff(np.r_[begin, len(at)]))] = docs.levels[level].values[at]
            out = tree.levels[item_level].products(item_nodes, dense[:, :len(nodes)])
            dense[found] = 0
            return out

        def visit(level: int, node: int, item_level: int, item_nodes: np.ndarray, bound: np.ndarray) -> None:
            # Scores found since the bounds were taken may have raised the floors.
            item_nodes = item_nodes[(bound >= self.floors[item_level][item_nodes]) & (bound > 0)]
            if not len(item_nodes):
                return
            if level == 0:
                while item_level:
                    item_nodes = tree.below(item_level, item_nodes)
                    item_level -= 1
                    bound = bounds(0, np.array([node]), item_level, item_nodes)[:, 0]
                    item_nodes = item_nodes[(bound >= self.floors[item_level][item_nodes]) & (bound > 0)]
                    if not len(item_nodes):
                        return
                self._score(docs, node, ids, tree.below(0, item_nodes), dense)
                return
            if item_level:
                item_nodes = tree.below(item_level, item_nodes)
                item_level -= 1
            nodes = docs.below(level, np.array([node]))
            found = bounds(level - 1, nodes, item_level, item_nodes)
            for i in np.argsort(-found.sum(axis=0), kind="stable"):
                visit(level - 1, int(nodes[i]), item_level, item_nodes, found[:, i])

        top, item_top = len(docs.levels) - 1, len(tree.levels) - 1
        root = np.array([0])
        visit(top, 0, item_top, root, bounds(top, root, item_top, root)[:, 0])

    def _score(self, docs: Hierarchy, leaf: int, ids: np.ndarray, items: np.ndarray, dense: np.ndarray) -> None:
        """Score a leaf of documents for some items in full and keep the best."""
        rows = docs.below(0, np.array([leaf]))
        at, begin = docs.rows.places(rows)
        columns = docs.rows.columns[at]
        dense[columns, np.repeat(np.arange(len(rows)), np.diff(np.r_[begin, len(at)]))] = docs.rows.values[at]
        scores = self.items.tree.rows.products(items, dense[:, :len(rows)])
        dense[columns] = 0
        self.scored += scores.size
        ids = ids[rows]
        last, last_id = self.scores[items, -1][:, None], self.ids[items, -1][:, None]
        better = (scores > 0) & ((scores > last) | ((scores == last) & (ids < last_id)))
        some = np.flatnonzero(better.any(axis=1))
        if not len(some):
            return
        items = items[some]
        all_scores = np.concatenate([self.scores[items], np.where(better[some], scores[some], 0)], axis=1)
        all_ids = np.concatenate([self.ids[items], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=-1)[:, :self.best]
        self.scores[items] = np.take_along_axis(all_scores, order, 1)
        self.ids[items] = np.take_along_axis(all_ids, order, 1)
        self._floors()


# On Spark


def _vectors(docs: DataFrame, number, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, times) of all documents with a term: their number of terms, and the occurrences of those in ``number``."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value.get
        for batch in batches:
            ids, lengths, starts, columns, times = [], [], [0], [], []
            for id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                for term, n in Counter(words).items():
                    at = known(term)
                    if at is not None:
                        columns.append(at)
                        times.append(n)
                ids.append(id)
                lengths.append(len(words))
                starts.append(len(columns))
            lists = lambda values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), lists(columns), lists(times)], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(read, "id long, n long, terms array<int>, times array<int>")


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents of several batches together, up to the size of a hierarchy; a batch that is larger comes in parts."""
    held, n, entries = [], 0, 0
    for batch in batches:
        starts = batch.column(2).offsets.to_numpy().astype("i8")
        at = 0
        while at < batch.num_rows:
            room = max(_CHUNK_ENTRIES - entries, 0)
            end = min(batch.num_rows, at + _CHUNK - n, max(int(np.searchsorted(starts, starts[at] + room, "right")) - 1, at + (not held)))
            if end > at:
                held.append(batch.slice(at, end - at))
                n, entries = n + end - at, entries + int(starts[end] - starts[at])
            if end < batch.num_rows:
                yield _joined(held)
                held, n, entries = [], 0, 0
            at = end
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    held = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    ids = held.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    starts = held.column(2).offsets.to_numpy().astype("i8")
    values = lambda i: held.column(i).flatten().to_numpy().astype("i8")
    return ids, held.column(1).to_numpy(), starts - starts[0], values(2), values(3)


def _searched(vectors: DataFrame, items, best: int) -> DataFrame:
    """(item, id, score): every partition's best documents of each item."""
    schema = pa.schema([("item", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = Search(items.value, best)
        for chunk in _chunks(b for b in batches if b.num_rows):
            running.add(*chunk)
        item, place = np.nonzero(running.scores)
        ids = running.ids[item, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype("i4")), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(running.scores[item, place])], schema=schema)

    return vectors.mapInArrow(search, "item int, id long, score long")


def ranked_documents(
    docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", items_at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """(item, rank, id, score): the ``best`` documents of every item with a score above 0.

    The documents are read once per ``items_at_once`` items, which with their terms
    go to every task. Partitions hand on their best documents only; of these the best
    of each of 64 parts of the ids are found first, so that an item's last task reads no
    more than 64 times ``best`` rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    asked = scratch.keep(items.groupBy(F.col(item_id_col).alias("item_id")).agg(F.max(item_text_col).cast("binary").alias("text")))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size.n // items_at_once), -(-size.bytes // ITEM_BYTES_AT_ONCE), 1)
    item_type = asked.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_id_col} {item_type}, rank int, {id_col} long, score long")
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        read = [(r.item_id, terms(r.text)) for r in rows]
        read = [(i, words) for i, words in read if words]
        number = {t: i for i, t in enumerate(sorted({t for _, words in read for t in words}))}
        if not number:
            continue
        vectors = scratch.keep(_vectors(docs, spark.sparkContext.broadcast(number), id_col, text_col))
        total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            continue
        holding = dict(map(tuple, vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))
        found = build_items([i for i, _ in read], [w for _, w in read], number, holding, total.docs, total.terms)
        local = scratch.keep(_searched(vectors, spark.sparkContext.broadcast(found), best))
        scratch.drop(vectors)
        names = spark.createDataFrame(list(enumerate(found.ids)), f"item int, {item_id_col} {item_type}")
        order = (F.col("score").desc(), F.col("id").asc_nulls_last())
        part = Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(*order)
        most = local.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= best)
        ranked = most.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= best)
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select(item_id_col, "rank", F.col("id").alias(id_col), "score"))
    return out
