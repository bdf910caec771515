"""Operator 1: bounded-space online packing of token ids into sequences of at most ``length`` ids.

Each partition keeps ``windows`` open windows. A document's whole stretches of ``length`` ids become sequences of their
own; the rest goes to the open window with the least room that still holds it (best fit). If none holds it, a new window
opens while there are fewer than ``windows``; otherwise the fullest window is topped up with as many ids as it has room
for and emitted, and the remaining ids are placed again. At the end the partition's open windows are merged: their
pieces follow one another in as few sequences as possible, so that a partition ends with at most one sequence that is
not full. The ids are those of the tokenizers library without special tokens added; a special token's string in a text
gives that token's id, as the library does by default, unless ``special_as_text``. Nothing is shuffled, and a partition holds no more than ``windows`` windows, whatever its size.

Nulls and ties: a null text counts as empty and yields the end id alone; a null id is kept; equal rows are packed one
by one; an empty table gives no pieces; other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.tokens import encoded

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Packer:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens), ids of 4 bytes each."""

    def __init__(self, length: int, windows: int, first_sequence: int):
        self.length, self.windows, self.next = length, windows, first_sequence
        self.open: list[tuple[int, int]] = []  # (room, number of the window), in order
        self.held: dict[int, list[tuple]] = {}
        self.made = 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        sequence, offset = self.next, 0
        self.next += 1
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, sequence, offset
            offset += len(ids) // 4

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        while total - at >= self.length:
            yield from self._emit([(doc, at, ids[4 * at : 4 * (at + self.length)], total)])
            at += self.length
        while at < total:
            need = total - at
            k = bisect_left(self.open, (need, -1))
            if k < len(self.open):
                room, window = self.open.pop(k)
            elif len(self.open) < self.windows:
                room, window = self.length, self.made
                self.made += 1
                self.held[window] = []
            else:
                room, window = self.open.pop(0)
            take = min(room, need)
            self.held[window].append((doc, at, ids[4 * at : 4 * (at + take)], total))
            at += take
            if room == take:
                yield from self._emit(self.held.pop(window))
            else:
                insort(self.open, (room - take, window))

    def finish(self) -> Iterator[tuple]:
        row: list[tuple] = []
        filled = 0
        for _, window in self.open:
            for doc, start, ids, total in self.held.pop(window):
                while ids:
                    part = ids[: 4 * (self.length - filled)]
                    row.append((doc, start, part, total))
                    ids, start, filled = ids[len(part) :], start + len(part) // 4, filled + len(part) // 4
                    if filled == self.length:
                        yield from self._emit(row)
                        row, filled = [], 0
        self.open = []
        if row:
            yield from self._emit(row)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, windows: int = 64, special_as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs``: each with its document, place in it, ids (unsigned 32-bit, little-endian), sequence and place there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, windows, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for doc, ids in zip(names, encoded(batch.column(1).to_pylist(), tokenizer, end_id, special_as_text)):
                for piece in packer.add(doc, ids):
                    rows.append(piece)
                    size += len(piece[3])
                if size > 8_000_000:
                    yield flush()
                    size = 0
        rows.extend(packer.finish())
        if rows:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, PIECES)


def sequences(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """Whole sequences (sequence_id, ids, length, padded_length): unpadded ids and the length after padding.

    A sequence is padded to ``length`` unless its own is a power of two. A group holds at most ``length`` ids.
    """
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda x, p: F.concat(x, p["ids"]))
    power = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    return rows.select("sequence_id", ids.alias("ids"), "length", F.when(power, F.col("length")).otherwise(F.lit(length).cast("long")).alias("padded_length"))
