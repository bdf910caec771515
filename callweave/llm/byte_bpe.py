"""Operator 13: byte-level BPE by ranks, encoded and decoded by DuckDB inside the tasks.

``encode`` cuts each text into the matches of the split pattern. A match that is a token itself is that token. All other
distinct matches of a batch of texts become token-position rows, one for each byte, and a recursive query contracts them: each
step joins adjacent tokens with the merge table, takes each word's pair of least rank, the leftmost of equals, and ends
when no word has a pair. Where no pair that the merged token can form has a lower rank than the merge itself, all
places of the pair that do not overlap are contracted in the same step, from the left, which gives what one at a time gives;
only words longer than ``LONG`` bytes need that. A query stops after ``STEPS`` steps and goes on from the rows reached, so
its rows stay bounded by the bytes put in.

``decode`` joins token-position rows with the vocabulary and aggregates their bytes in the order of positions.

The merge table holds every way to put a token together from two tokens. Texts are split before spaces first, where no match
of the pattern can reach across, so that the ids of frequent words are kept between texts (``CACHE`` of them and as many
matches, and those of a batch at most; then they are dropped and learned again); a text with other white space is matched as
a whole.

Nulls and ties: a null text counts as empty and has no tokens; a null id is kept; repeated rows are separate rows; an empty
table gives an empty result; other columns are left out. Texts are never cut: a long one passes in blocks of ``BLOCK`` tokens
when it is decoded. Every shape of text works in memory in proportion to the batch (``CHARS``) or to its longest text. A word
of n bytes without repeated pairs takes n steps, each over the tokens left of it: some seconds for 5,000 letters in a run.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 600_000
CHARS = 2_000_000
BLOCK = 1_000_000
BYTES = 1_000_000
LONG = 48
STEPS = 400
BETWEEN = chr(256)  # stands between texts where they are decoded together; no byte's letter
_CODERS: dict[tuple[str, str], "Coder"] = {}

ONE = """
WITH RECURSIVE step AS (
  SELECT word, ids, true AS open FROM given
  UNION ALL
  SELECT word, CASE WHEN best IS NULL THEN ids ELSE ids[:(best & 4294967295) - 1] || [(best >> 32)::INTEGER] || ids[(best & 4294967295) + 2:] END, best IS NOT NULL FROM (
    SELECT word, any_value(ids) AS ids, min((m::BIGINT << 32) + pos) AS best
    FROM (SELECT word, ids, unnest(range(1, len(ids))) AS pos, unnest(ids[:len(ids) - 1]) AS a, unnest(ids[2:]) AS b FROM step WHERE open) LEFT JOIN merges USING (a, b)
    GROUP BY word))
SELECT word, ids FROM step WHERE NOT open
"""
ALL = """
WITH RECURSIVE step AS (
  SELECT word, pos, id, true AS open, 0 AS steps FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN hit THEN m ELSE id END, best IS NOT NULL, steps + 1 FROM (
    SELECT *, lag(hit, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone FROM (
      SELECT *, coalesce(CASE WHEN bool_or(lower AND m = best >> 32) OVER (PARTITION BY word) THEN pos = best & 4294967295 ELSE m = best >> 32 AND (id <> next OR (n - run) % 2 = 0) END, false) AS hit FROM (
        SELECT word, pos, id, next, steps, p.m, n, max(CASE WHEN before = id THEN NULL ELSE n END) OVER (PARTITION BY word ORDER BY pos) AS run,
          coalesce(l.m < p.m, false) OR coalesce(r.m < p.m, false) OR coalesce(t.m < p.m, false) AS lower, min((p.m::BIGINT << 32) + pos) OVER (PARTITION BY word) AS best
        FROM (SELECT word, pos, id, steps, lag(id, 1, -1) OVER w AS before, lead(id) OVER w AS next, lead(id, 2) OVER w AS after, row_number() OVER w AS n
              FROM step WHERE open AND steps < {limit} WINDOW w AS (PARTITION BY word ORDER BY pos))
        LEFT JOIN merges AS p ON p.a = id AND p.b = next LEFT JOIN merges AS l ON l.a = before AND l.b = p.m
        LEFT JOIN merges AS r ON r.a = p.m AND r.b = after LEFT JOIN merges AS t ON t.a = p.m AND t.b = p.m)))
  WHERE NOT gone)
SELECT word, pos, id, open FROM step WHERE NOT open OR steps = {limit} ORDER BY word, pos
""".format(limit=STEPS)
DECODE = "SELECT array_to_string(list(letters ORDER BY place), '') FROM tokens JOIN vocabulary USING (id)"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def white(pattern: str) -> str:
    """The pattern with white space as Unicode has it, whatever the regular expression library takes for it."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Coder:
    """A vocabulary, its merge table in a DuckDB of its own, and the ids of words met before."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import numpy as np
        import regex

        self.ranks = ranks_of(path)
        self.pattern = regex.compile(white(pattern))
        self.first: dict[str, bytes | None] = {}
        self.rest: dict[str, bytes | None] = {}
        self.tokens = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.words = dict(self.tokens)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.base = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        rows = []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    rows.append((a, b, rank))
        a, b, m = (np.array(c, np.int32) for c in (zip(*rows) if rows else ((), (), ())))
        self.put("merges", a=a, b=b, m=m)
        ids = np.array([-1, *self.ranks.values()], np.int32)
        self.put("vocabulary", id=ids, letters=[BETWEEN, *(token.decode("latin-1") for token in self.ranks)])
        self.known = np.zeros(max(self.ranks.values()) + 1, bool)
        self.known[ids[1:]] = True

    def put(self, name: str, **columns) -> None:
        given = pa.table(columns)
        self.base.register("given", given)
        self.base.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.base.unregister("given")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (no token itself) as unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            short, held, part = len(words[order[at]]) <= LONG, 0, []
            while at < len(order) and short == (len(words[order[at]]) <= LONG) and (not part or held + len(words[order[at]]) <= (BYTES if short else LONG * STEPS)):
                held += len(words[order[at]])
                part.append(order[at])
                at += 1
            for k, ids in (self.one if short else self.all)([words[k] for k in part]):
                out[part[k]] = ids
        return out

    def one(self, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(number, ids) of each word, by the query that contracts one pair of a word at a time."""
        import numpy as np

        ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.byte[np.frombuffer(b"".join(words), np.uint8)]))
        given = pa.table({"word": np.arange(len(words), dtype=np.int32), "ids": lists})
        self.base.register("given", given)
        for batch in self.base.sql(ONE).to_arrow_table().to_batches():
            found, ends = batch.column(1).flatten().to_numpy().astype("<u4").tobytes(), np.cumsum([0, *batch.column(1).value_lengths().to_pylist()]).tolist()
            for word, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                yield word, found[4 * a : 4 * b]
        self.base.unregister("given")

    def all(self, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(number, ids) of each word, by the query that contracts all places of a pair; it goes on from where it stopped."""
        import numpy as np

        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        while len(word):
            self.put("start", word=word, pos=pos.astype(np.int32), id=ids)
            word, pos, ids, still = (c.to_numpy() for c in self.base.sql(ALL).to_arrow_table().columns)
            ready = np.flatnonzero(~still)
            cuts = np.flatnonzero(np.diff(word[ready], prepend=-1, append=-1))
            values = ids[ready].astype("<u4")
            yield from ((int(word[ready[a]]), values[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]))
            word, pos, ids = word[still], pos[still], ids[still]

    def ids_of(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, cut by the pattern on its own."""
        cut = [[m.encode() for m in self.pattern.findall(text)] for text in texts]
        if len(self.words) > CACHE:
            self.words = dict(self.tokens)
        rare = list(set(chain.from_iterable(cut)).difference(self.words))
        self.words.update(zip(rare, self.contract(rare)))
        ids = self.words
        return [b"".join([ids[m] for m in matches]) for matches in cut]

    def learn(self, words: set[str], known: dict[str, bytes | None], space: str) -> None:
        """The ids of words between spaces; none for those beside other white space, whose text must be cut as a whole."""
        fit = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        known.update(dict.fromkeys(words))
        known.update(zip(fit, self.ids_of([space + w for w in fit])))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.rest) > CACHE:
            self.first, self.rest = {}, {}
        lines = [[line.split(" ") for line in text.split("\n")] if text else [] for text in texts]
        heads, others = set(), set()
        for line in chain.from_iterable(lines):
            heads.add(line[0])
            others.update(line[1:])
        self.learn(heads.difference(self.first), self.first, "")
        self.learn(others.difference(self.rest), self.rest, " ")
        (end,) = self.ids_of(["\n"])
        out: list[bytes | None] = []
        for text in lines:
            parts = [[self.first[line[0]], *[self.rest[w] for w in line[1:]]] for line in text]
            out.append(None if any(None in p for p in parts) else end.join([b"".join(p) for p in parts]))
        odd = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(odd, self.ids_of([texts[k] for k in odd])):
            out[k] = ids
        return out

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids."""
        import numpy as np

        ids = [np.frombuffer(x, "<u4") for x in encoded]
        for x in ids:
            if len(x) and (x.max() >= len(self.known) or not self.known[x].all()):
                raise ValueError("an id is not in the vocabulary")
        stream = np.concatenate([np.append(x.astype(np.int32), np.int32(-1)) for x in ids]) if ids else np.zeros(0, np.int32)
        letters = []
        for at in range(0, len(stream), BLOCK):
            part = stream[at : at + BLOCK]
            tokens = pa.table({"place": np.arange(len(part), dtype=np.int32), "id": part})
            self.base.register("tokens", tokens)
            letters.append(self.base.sql(DECODE).to_arrow_table().column(0)[0].as_py())
            self.base.unregister("tokens")
        return [text.encode("latin-1") for text in "".join(letters).split(BETWEEN)[:-1]]


def coder(path: str, pattern: str) -> Coder:
    """One for each Python worker; what it has learned serves the worker's later tasks too."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def in_parts(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose sizes sum up to ``most``, or of one row."""
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (unsigned little-endian 32-bit integers) of each text, with ``decoded`` also the bytes decoded from them."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), *[("decoded", pa.binary())] * decoded])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t or "") for t in batch.column(1).to_pylist()]
            for part in in_parts(batch, sizes, CHARS):
                own = coder(path, pattern)
                ids = own.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(own.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, ids binary" + ", decoded binary" * decoded)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary) of rows that hold ids as :func:`encode` gives them; null ids count as none."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x or b"") for x in batch.column(1).to_pylist()]
            for part in in_parts(batch, sizes, CHARS):
                found = coder(path, pattern).decode([x or b"" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], schema=schema)

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(task, "doc_id long, decoded binary")
