"""What each filter of a chain removes, for every order of the chain, by decision diagrams.

A document's failure mask says which filters it fails. Spark counts the documents of
every part and mask; the masks of a part, at most two to the power of the filters,
become a decision diagram: one level per filter, a branch for documents that pass it
and one for those that fail it, and on every node the number of documents below it.
Swapping two neighbouring levels changes the nodes of the upper level and their
children only, and every order of the filters is one such swap away from another, so
that the diagram goes through all of them. In each order the path that passes every
level gives the steps: what hangs off it on the failing side is what the step removes.

Odd rows: a null text is an empty one, a null part is an empty string. Repeated rows
count as often as they come. A document is a copy if any smaller id has its text; rows
without an id are neither copies nor smaller than others, and have no labels. Of
repeated labels of an id a 1 holds; labels without an id count for nothing. No
documents give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch

_WORD = r"[^\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def too_short(text: Column) -> Column:
    """Under 100 words."""
    return F.size(_words(text)) < 100


def repetitive(text: Column) -> Column:
    """Under 80 distinct words in 100."""
    return F.size(F.array_distinct(_words(text))) * F.lit(100).cast("long") < F.size(_words(text)) * F.lit(80).cast("long")


def shouting(text: Column) -> Column:
    """More than 10 of 100 code points are ASCII capitals."""
    length = F.char_length(text).cast("long")
    capitals = length - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return capitals * 100 > length * 10


def marked(text: Column) -> Column:
    """Holds a mark of markup or of noise."""
    return text.rlike("[#$%&*|]")


# Letter and failure condition of each filter that looks at the text alone, and the letter of the filter of copies.
CONDITIONS: dict[str, Callable[[Column], Column]] = {"A": too_short, "B": repetitive, "C": shouting, "D": marked}
COPIES = "E"


class Diagram:
    """Ordered decision diagram of weighted masks; a weight is a tuple of counts.

    A node is a number; number 0 stands for no documents at all. Every level keeps
    its nodes by their pair (passing child, failing child), so that equal ones are
    one node. ``weight`` holds the sum of the counts below a node.
    """

    def __init__(self, order: str, counts: dict[int, tuple[int, ...]], width: int):
        """``counts`` by mask; bit i of a mask is set if filter i of ``order`` fails."""
        self.order = list(order)
        self.children: list[tuple[int, int]] = [(0, 0)]
        self.weight: list[tuple[int, ...]] = [(0,) * width]
        self.levels: list[dict] = [{} for _ in order]
        leaves: dict[tuple[int, ...], int] = {}
        nodes = [self._leaf(leaves, counts.get(mask)) for mask in range(1 << len(order))]
        for level in reversed(self.levels):
            half = len(nodes) // 2
            nodes = [self._node(level, nodes[i], nodes[i + half]) for i in range(half)]
        self.root = nodes[0]

    def _leaf(self, leaves: dict, counts: tuple[int, ...] | None) -> int:
        if not counts or not any(counts):
            return 0
        if counts not in leaves:
            leaves[counts] = self._add((0, 0), counts)
        return leaves[counts]

    def _add(self, children: tuple[int, int], weight: tuple[int, ...]) -> int:
        self.children.append(children)
        self.weight.append(weight)
        return len(self.weight) - 1

    def _node(self, level: dict, passing: int, failing: int) -> int:
        pair = (passing, failing)
        if pair == (0, 0):
            return 0
        if pair not in level:
            level[pair] = self._add(pair, tuple(a + b for a, b in zip(self.weight[passing], self.weight[failing])))
        return level[pair]

    def swap(self, at: int) -> None:
        """Exchange the filters of level ``at`` and the one below it; nodes of other levels stay as they are."""
        upper, lower = {}, {}
        for node in self.levels[at].values():
            passing, failing = self.children[node]
            (both, second), (first, none) = self.children[passing], self.children[failing]
            pair = self._node(lower, both, first), self._node(lower, second, none)
            self.children[node] = pair
            upper[pair] = node
        self.levels[at], self.levels[at + 1] = upper, lower
        self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]

    def steps(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, kept, removed) along the path that passes every level."""
        node = self.root
        for letter in self.order:
            node, failing = self.children[node]
            yield letter, self.weight[node], self.weight[failing]

    def fails_only(self, letter: str) -> tuple[int, ...]:
        """Counts of what fails this filter and passes all others."""
        node = self.root
        for other in self.order:
            node = self.children[node][other == letter]
        return self.weight[node]


def level_swaps(n: int) -> Iterator[int]:
    """Levels to exchange with the next one, one after the other, to go through all orders of n filters.

    The last filter moves through the orders of the others, up and down in turn.
    """
    if n < 2:
        return
    on_top = False
    for other in (None, *level_swaps(n - 1)):
        if other is not None:
            yield other + on_top
        yield from range(n - 1) if on_top else range(n - 2, -1, -1)
        on_top = not on_top


def interactions(letters: str, counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """Steps of all orders of the filters: (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``counts`` holds (documents, good ones, toxic ones) by mask.
    """
    diagram = Diagram(letters, counts, 3)
    failing = {x: sum(c[0] for mask, c in counts.items() if mask >> i & 1) for i, x in enumerate(letters)}
    alone = {x: diagram.fails_only(x)[0] for x in letters}
    shares = dict.fromkeys(letters, 0)
    found = []
    for at in (None, *level_swaps(len(letters))):
        if at is not None:
            diagram.swap(at)
        order = "".join(diagram.order)
        for step, (letter, kept, removed) in enumerate(diagram.steps(), 1):
            shares[letter] += removed[0]
            found.append((order, step, letter, kept[0], removed[0], failing[letter] - removed[0], alone[letter], removed[1], removed[2]))
    return [(order, step, *rest, shares[letter]) for order, step, letter, *rest in found]


def failure_counts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    conditions: dict[str, Callable[[Column], Column]] = CONDITIONS,
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failure mask; bit i is the i-th condition, the bit after them a copy.

    Texts are read once and leave a digest. Equal rows are counted before anything
    is joined; whether a row is the first of its text is looked up by digest and id
    together, so that a text with many copies is many keys.
    """
    scratch = Scratch(docs.sparkSession, "failure-masks")
    text = F.col("text")
    bits = F.lit(0)
    for i, fails in enumerate(conditions.values()):
        bits = bits + F.when(fails(text), 1 << i).otherwise(0)
    read = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = scratch.keep(
        read.select("id", "part", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), bits.alias("mask"))
        .groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    first = marks.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    flags = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flags = flags.filter("id is not null").withColumn("spread", F.lit(0).cast("long"))
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    # Rows without an id match nothing; they are spread by their text.
    known = marks.join(first.hint("merge"), ["digest", "id"], "left").withColumn(
        "spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))
    known = known.join(flags.hint("merge"), ["id", "spread"], "left")
    return known.groupBy("part", (F.col("mask") + F.when(copy, 1 << len(conditions)).otherwise(0)).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    conditions: dict[str, Callable[[Column], Column]] = CONDITIONS, copies: str = COPIES,
) -> DataFrame:
    """One row per part, order of the filters and step.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley): what the step leaves and removes, what its filter would
    have removed but an earlier one did, what no other filter catches, the documents
    labelled good and toxic among the removed, and its filter's removals summed over
    all orders. Rows grow with the factorial of the filters; a part's counts, at most
    two to their power, go to one task.
    """
    letters = "".join(conditions) + copies

    def of_part(masks: pd.DataFrame) -> pd.DataFrame:
        counts = {m: (n, good, toxic) for m, n, good, toxic in masks[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        out = pd.DataFrame(interactions(letters, counts), columns=[
            "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
        out.insert(0, "part", masks["part"].iloc[0])
        return out

    counts = failure_counts(docs, labels, id_col, text_col, part_col, conditions)
    return counts.groupBy("part").applyInPandas(
        of_part, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long")
