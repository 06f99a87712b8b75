"""Bounded-space online packing of documents into sequences of token ids.

Each partition is packed as it is read, with a fixed number of open windows. A
document's full windows are sequences of their own; the rest of it goes to the
open window it fits best. When it fits none, the fullest window is topped up with
the rest's beginning and emitted, and what remains is placed the same way, so
emitted windows carry no padding. What stays open at the end of the partitions is
merged in rounds: groups of a fixed number of partitions are packed again and
leave one open window each, until one window is left; it is cut into sequences
whose lengths are powers of two.

Memory per task is the open windows and one document, in the merging rounds the
open windows of ``FAN_IN`` partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch
from codeloom.llm.tokens import default_path, encoder

WINDOW = 2048
OPEN_WINDOWS = 16
FAN_IN = 16
END_ID = 1
_ROWS_AT_ONCE = 4096
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


class Packer:
    """Open windows of one task; a piece is (id, start, ids as bytes, tokens of its document)."""

    def __init__(self, window: int, open_windows: int, first_sequence: int):
        self.window, self.most, self.sequence = window, open_windows, first_sequence
        self.open: list[list] = []  # [tokens so far, pieces]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple], carry: bool = False) -> None:
        """Rows of one sequence; with ``carry`` the ids go along, for a later round."""
        offset = 0
        for id_, start, ids, total in pieces:
            length = len(ids) // 4
            self.rows.append((id_, start, length, zlib.crc32(ids), total, self.sequence, offset, ids if carry else None))
            offset += length
        self.sequence += 1

    def add(self, id_, start: int, ids: bytes, total: int) -> None:
        window = self.window
        while len(ids) >= window * 4:
            self._emit([(id_, start, ids[: window * 4], total)])
            ids, start = ids[window * 4:], start + window
        while ids:
            length = len(ids) // 4
            fitting = [w for w in self.open if w[0] + length <= window]
            if fitting:
                best = max(fitting, key=lambda w: w[0])
            elif len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
            taken = ids[: (window - best[0]) * 4]
            best[1].append((id_, start, taken, total))
            best[0] += len(taken) // 4
            if best[0] == window:
                self.open.remove(best)
                self._emit(best[1])
            ids, start = ids[len(taken):], start + len(taken) // 4

    def leave_open(self) -> None:
        for _, pieces in self.open:
            self._emit(pieces, carry=True)
        self.open = []

    def merge_open(self) -> None:
        """Join the open windows end to end until at most one is left."""
        rest = sorted(self.open, key=lambda w: -w[0])
        self.most, self.open = 1, []
        for _, pieces in rest:
            for piece in pieces:
                self.add(*piece)

    def close(self) -> None:
        """Emit what is left in lengths that are powers of two."""
        self.merge_open()
        for length, pieces in self.open:
            while length:
                size = 1 << (length.bit_length() - 1)
                part, room = [], size
                while room:
                    id_, start, ids, total = pieces[0]
                    taken = ids[: room * 4]
                    part.append((id_, start, taken, total))
                    room -= len(taken) // 4
                    if len(taken) == len(ids):
                        pieces = pieces[1:]
                    else:
                        pieces = [(id_, start + len(taken) // 4, ids[len(taken):], total), *pieces[1:]]
                self._emit(part)
                length -= size
        self.open = []

    def batches(self, schema: pa.Schema, all_rows: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_rows or len(self.rows) >= _ROWS_AT_ONCE):
            rows, self.rows = self.rows, []
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _schemas(docs: DataFrame, id_col: str) -> tuple[str, pa.Schema]:
    kind = docs.schema[id_col].dataType
    ddl = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.binary()]
    return ddl, pa.schema(list(zip(_FIELDS, types)))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and ``end_id``; ``start`` counts its ids
    before the piece, ``offset`` the ids before the piece in its sequence. A null or
    empty text is ``end_id`` alone. Repeated rows and equal or null ids are documents
    of their own. Other columns are not read. An empty table gives no rows.
    """
    path = tokenizer_path or default_path()
    ddl, schema = _schemas(docs, id_col)
    end = int(end_id).to_bytes(4, "little")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                ids = (encode.packed(text) if text else b"") + end
                packer.add(id_.as_py(), 0, ids, len(ids) // 4)
                yield from packer.batches(schema)
        packer.leave_open()
        yield from packer.batches(schema, True)

    scratch = Scratch(docs.sparkSession, "packing")
    packed = scratch.keep(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(first_pass, ddl))
    done, level = [packed], 1
    group = lambda: F.shiftright("sequence_id", 32).bitwiseAND((1 << 24) - 1)
    left = packed.filter("ids is not null").withColumn("part", (group() / FAN_IN).cast("long"))
    parts = left.select("part").distinct().count()
    while parts:
        last, base = parts == 1, level << 56

        def merge(table: pa.Table) -> pa.Table:
            table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            packer = Packer(window, open_windows, base | table["part"][0].as_py() << 32)
            for id_, start, ids, total in zip(*(table[c] for c in ("doc_id", "start", "ids", "doc_tokens"))):
                packer.add(id_.as_py(), start.as_py(), ids.as_py(), total.as_py())
            if last:
                packer.close()
            else:
                packer.merge_open()
                packer.leave_open()
            return pa.Table.from_batches(list(packer.batches(schema, True)), schema)

        packed = scratch.keep(left.groupBy("part").applyInArrow(merge, ddl))
        done.append(packed)
        if last:
            break
        left = packed.filter("ids is not null").withColumn("part", (group() / FAN_IN).cast("long"))
        parts, level = left.select("part").distinct().count(), level + 1
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.filter("ids is null").drop("ids")
