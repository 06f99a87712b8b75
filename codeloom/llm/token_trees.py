"""Token counts that follow edits: a segment tree of pre-token runs per document.

A text is cut into leaves of about ``LEAF`` characters at places where a pre-token
begins whatever stands further away (a space between two characters that are not
white space), so the token count of a text is the sum of its leaves' counts. Two
heap-ordered trees hold the sums of characters and of tokens.

An edit touches the leaves from the last cut at least two characters before it
to the first cut behind the character that follows it; no other cut can change.
That region is cut and encoded anew, and the sums above its leaves are updated. A
region that needs more leaves than it had gets the trees rebuilt from the leaves'
counts, without encoding anything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tokens import CUT, default_path, encoder

LEAF = 512
_CHUNK = 4 << 20


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """The text in runs that end at the first safe place after ``leaf`` characters."""
    out, start = [], 0
    while start < len(text):
        m = CUT.search(text, start + leaf) if start + leaf < len(text) else None
        end = m.start() if m else len(text)
        out.append(text[start:end])
        start = end
    return out


def heap(leaves: list[int]) -> list[int]:
    """Sums in heap order: node 1 is the root, node k has children 2k and 2k + 1, the leaves fill the second half."""
    size = 1
    while size < len(leaves):
        size *= 2
    nodes = [0] * size + leaves + [0] * (size - len(leaves))
    for k in range(size - 1, 0, -1):
        nodes[k] = nodes[2 * k] + nodes[2 * k + 1]
    return nodes


class TokenTree:
    def __init__(self, encode, leaves: list[str], chars: list[int], tokens: list[int], leaf: int = LEAF):
        """``leaves`` are the texts of the slots in the second half of the heaps ``chars`` and ``tokens``."""
        self.encode, self.leaves, self.chars, self.tokens, self.leaf = encode, leaves, chars, tokens, leaf
        self.encoded = 0  # characters encoded so far

    @classmethod
    def of(cls, encode, text: str, leaf: int = LEAF) -> "TokenTree":
        leaves = cut(text, leaf)
        return cls(encode, leaves, heap([len(x) for x in leaves]), heap([len(encode(x)) for x in leaves]), leaf)

    @classmethod
    def stored(cls, encode, text: str, chars: list[int], tokens: list[int], leaf: int = LEAF) -> "TokenTree":
        leaves, at = [], 0
        for n in chars[len(chars) // 2:]:
            leaves.append(text[at:at + n])
            at += n
        while leaves and not leaves[-1]:
            leaves.pop()
        return cls(encode, leaves, list(chars), list(tokens), leaf)

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _slot(self, position: int) -> tuple[int, int]:
        """The slot that holds the character at a position, and where it begins."""
        k, size, start = 1, len(self.chars) // 2, 0
        while k < size:
            k *= 2
            if position - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - size, start

    def replace(self, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters at ``start``; what lies outside of the text is left out."""
        total = self.chars[1]
        start = min(max(start, 0), total)
        end = min(start + max(length, 0), total)
        if not self.leaves:
            first, last, begin, old = 0, -1, 0, ""
        else:
            first, begin = self._slot(max(start - 2, 0))
            last = self._slot(end)[0] if end < total else len(self.leaves) - 1
            old = "".join(self.leaves[first:last + 1])
        region = cut(old[:start - begin] + new + old[end - begin:], self.leaf)
        counts = [len(self.encode(x)) for x in region]
        self.encoded += sum(map(len, region))
        slots = last + 1 - first
        if len(region) > slots:
            tokens = self.tokens[len(self.tokens) // 2:][:len(self.leaves)]
            self.leaves[first:last + 1] = region
            tokens[first:last + 1] = counts
            kept = [(x, n) for x, n in zip(self.leaves, tokens) if x]
            self.leaves = [x for x, _ in kept]
            self.chars, self.tokens = heap([len(x) for x in self.leaves]), heap([n for _, n in kept])
            return
        region += [""] * (slots - len(region))
        counts += [0] * (slots - len(counts))
        self.leaves[first:last + 1] = region
        for nodes, values in ((self.chars, [len(x) for x in region]), (self.tokens, counts)):
            low, high = len(nodes) // 2 + first, len(nodes) // 2 + last
            nodes[low:high + 1] = values
            while low > 1:
                low, high = low // 2, high // 2
                for k in range(low, high + 1):
                    nodes[k] = nodes[2 * k] + nodes[2 * k + 1]


# On Spark

_TREES = "chars_tree array<int>, tokens_tree array<int>, n_tokens long"
_EDITED = "text string, chars_tree array<int>, tokens_tree array<int>, n_tokens long, n_tokens_before long, encoded_chars long"
_TREES_ARROW = [("chars_tree", pa.list_(pa.int32())), ("tokens_tree", pa.list_(pa.int32())), ("n_tokens", pa.int64())]


def _mapped(docs: DataFrame, columns: list, work, id_col: str, ddl: str, fields: list) -> DataFrame:
    """One output row per input row, by ``work`` over (id, …), in batches bounded by the size of their texts."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for values in zip(*batch.columns):
                row = work(*(v.as_py() for v in values[1:]))
                rows.append((values[0].as_py(), *row))
                held += sum(len(x) for x in row if isinstance(x, (str, list))) + 100
                if held >= _CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(*columns).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {ddl}")


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(id, text, chars_tree, tokens_tree, n_tokens) per row: what ``apply_edits`` starts from, to be stored as a table.

    A null or empty text has trees of one zero and no tokens. Rows with equal or null
    ids are documents of their own. An empty table gives no rows.
    """
    path = tokenizer_path or default_path()

    def work(text: str | None) -> tuple:
        tree = TokenTree.of(encoder(path).ids, text or "", leaf)
        return text, tree.chars, tree.tokens, tree.tokens[1]

    return _mapped(docs, [F.col(id_col), F.col(text_col)], work, id_col, f"text string, {_TREES}", [("text", pa.string()), *_TREES_ARROW])


def apply_edits(trees: DataFrame, edits_col: str = "edits", id_col: str = "doc_id", tokenizer_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The table of ``build_trees`` after each row's edits, plus ``n_tokens_before`` and ``encoded_chars``.

    ``edits`` is an array of structs (start, length, text) applied in order; positions
    are code points of the text as it is by then. What an edit replaces beyond the end
    is left out, a negative start is 0, a null text is empty, and a null edit, or one
    without start or length, does nothing. Null arrays are empty.
    """
    path = tokenizer_path or default_path()

    def work(text, chars, tokens, edits) -> tuple:
        tree = TokenTree.stored(encoder(path).ids, text or "", chars, tokens, leaf)
        before = tree.tokens[1]
        for edit in edits or ():
            if edit is not None and edit["start"] is not None and edit["length"] is not None:
                tree.replace(edit["start"], edit["length"], edit["text"] or "")
        return tree.text, tree.chars, tree.tokens, tree.tokens[1], before, tree.encoded

    fields = [("text", pa.string()), *_TREES_ARROW, ("n_tokens_before", pa.int64()), ("encoded_chars", pa.int64())]
    edits = F.transform(edits_col, lambda e: F.when(e.isNotNull(), F.struct(
        e["start"].cast("long").alias("start"), e["length"].cast("long").alias("length"), e["text"].alias("text")))).alias("edits")
    return _mapped(trees, [F.col(id_col), F.col("text"), F.col("chars_tree"), F.col("tokens_tree"), edits], work, id_col, _EDITED, fields)
