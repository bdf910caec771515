"""Operator 6: token ids in Arrow files of fixed-size lists, for random access without copying.

The ids of all documents, in ascending order of id, form one stream. Each partition of a range partitioning writes its
stretch of the stream as one shard: an Arrow file ``shard-N.arrow`` whose record batches hold ``rows`` sequences of
``length`` ids (fixed-size lists of unsigned integers, 16 bits wide where the vocabulary allows it, else 32) and equally
long masks (1: an id, 0: padding, only at a shard's end), and ``shard-N.docs.arrow`` with each document's place in the
shard. Sequence k of a shard is row k % rows of batch k // rows, so a reader maps the file and slices it. Files are
written under another name and moved, so that a repeated task replaces a shard by an equal one.

Nulls and ties: a null text counts as empty and yields the end id alone; null ids come first; equal ids are ordered by
text; an empty table writes no shard and reads back as an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.llm.common import one_task_each, written
from callweave.llm.tokens import encoded, vocabulary_size

ROWS = 256
MANIFEST = "shard long, path string, docs long, tokens long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def place(uri: str):
    """The file system of a URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = 1024, special_as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards under ``folder`` and returns their manifest, a row for each shard."""
    import numpy as np

    dtype, item = (np.dtype("<u2"), pa.uint16()) if max(vocabulary_size(tokenizer), end_id + 1) <= 65536 else (np.dtype("<u4"), pa.uint32())
    schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs, tokens = TaskContext.get().partitionId(), 0, 0
        filesystem, path = place(f"{folder}/shard-{shard:06d}.arrow")
        attempt = f"{path}.{TaskContext.get().taskAttemptId()}"
        full = pa.array(np.ones(ROWS * length, bool))
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(f"{attempt}.docs") as docs_out, filesystem.open_output_stream(attempt) as out, pa.ipc.new_file(docs_out, _DOCS) as index, pa.ipc.new_file(out, schema) as sink:
            held: list = []
            waiting = 0

            def put(values, mask) -> None:
                sink.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(values, item), length), pa.FixedSizeListArray.from_arrays(mask, length)], schema=schema))

            for batch in [first], batches:
                for part in batch:
                    starts, counts = [], []
                    for ids in encoded(part.column(1).to_pylist(), tokenizer, end_id, special_as_text):
                        held.append(np.frombuffer(ids, "<u4").astype(dtype))
                        starts.append(tokens)
                        counts.append(len(held[-1]))
                        tokens += counts[-1]
                        waiting += counts[-1]
                        if waiting >= ROWS * length:
                            values, at = np.concatenate(held), 0
                            while len(values) - at >= ROWS * length:
                                put(values[at : at + ROWS * length], full)
                                at += ROWS * length
                            held, waiting = [values[at:]], len(values) - at
                    index.write_batch(pa.record_batch([part.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=_DOCS))
                    docs += part.num_rows
            if waiting:
                padded = -(-waiting // length) * length
                put(np.concatenate([*held, np.zeros(padded - waiting, dtype)]), pa.array(np.arange(padded) < waiting))
        filesystem.move(f"{attempt}.docs", f"{path[:-6]}.docs.arrow")
        filesystem.move(attempt, path)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.arrow"], "docs": [docs], "tokens": [tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(task, MANIFEST), "manifest")


class Shard:
    """One shard, mapped into memory where its file system is local."""

    def __init__(self, uri: str):
        filesystem, path = place(uri)
        from pyarrow import fs

        local = isinstance(filesystem, fs.LocalFileSystem)
        opened = (lambda p: pa.memory_map(p)) if local else filesystem.open_input_file
        self.reader = pa.ipc.open_file(opened(path))
        self.index = pa.ipc.open_file(opened(f"{path[:-6]}.docs.arrow"))
        self.length = self.reader.schema.field("ids").type.list_size
        self.held: tuple[int, object] = (-1, None)
        self.held_mask: tuple[int, object] = (-1, None)

    def batch(self, k: int):
        """The ids of record batch ``k`` as a flat array that points into the file."""
        if self.held[0] != k:
            self.held = k, self.reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.held[1]

    def masked(self, k: int):
        """The masks of record batch ``k``, one value an id."""
        if self.held_mask[0] != k:
            self.held_mask = k, self.reader.get_batch(k).column(1).flatten().to_numpy(zero_copy_only=False)
        return self.held_mask[1]

    def sequence(self, k: int):
        """Sequence ``k`` and its mask."""
        ids = self.batch(k // ROWS)[k % ROWS * self.length : (k % ROWS + 1) * self.length]
        return ids, self.reader.get_batch(k // ROWS).column(1)[k % ROWS].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int):
        """``count`` ids of the stream from ``start`` on."""
        import numpy as np

        size, parts = ROWS * self.length, []
        while count:
            k, at = divmod(start, size)
            parts.append(self.batch(k)[at : at + count])
            if not self.masked(k)[at : at + count].all():
                raise ValueError("a document reaches into a shard's padding")
            start, count = start + len(parts[-1]), count - len(parts[-1])
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def read(manifest: DataFrame) -> DataFrame:
    """A row for each document from the shards: doc_id, start in the whole stream, n_tokens and ids (unsigned 32-bit)."""
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                shard = Shard(path)
                for k in range(shard.index.num_record_batches):
                    index = shard.index.get_batch(k)
                    for at in range(0, index.num_rows, 2000):
                        part = index.slice(at, 2000)
                        starts, counts = part.column(1).to_pylist(), part.column(2).to_pylist()
                        ids = [shard.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts, counts)]
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([base + s for s in starts], pa.int64()), part.column(2), pa.array(ids, pa.binary())], schema=_READ)

    return one_task_each(bases, "shard").mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")
