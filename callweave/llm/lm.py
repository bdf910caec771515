"""Operator 2: a log-bilinear language model, trained by noise-contrastive estimation, scores whole texts.

Tokens are words (runs of characters other than ASCII white space, A-Z lower-cased) and one end for each text.

Outputs: the ``own`` most frequent tokens are outputs of their own; all others share ``buckets`` outputs by their last two
bytes. A token of a bucket has a share of it: its count raised by 0.1, and one such share for all unseen tokens.

Vocabulary: every token that occurs ``LEAST`` times or more in the training texts is modelled, however many there are. One of
a bucket has a vector of its own as a context and one as a word, so that with o(x) for the output of x

    P(w | h) = P(o(w) | h) P(w | o(w), o(h)),  P(o | h) ~ exp((u_o(h) + t_h) q_o + b_o),  P(w | o, c) ~ share(w) exp(u_c v_w + a_w)

where u is r C of the outputs' model, and t, v and a are zero for tokens that are not modelled. Both factors are normalised
exactly, the first over all outputs, the second over all tokens of the bucket, so that the probabilities of all tokens after
a context sum to one. What remains bounded: a context is the one token before, and v_w meets it by its output.

Training: Spark counts tokens, then pairs of an output and the one before it (the end stands before the first), over all
training texts; tasks add up matrices of a fixed size, which are summed by key. The model scores output w after h as
r_h C q_w + b_w. Because it sees h alone, the noise-contrastive loss over all tokens, with ``noise`` noise tokens to each in
expectation, is a function of those counts, and numpy minimises it without sampling. The counts that reach the driver are
bounded by the outputs squared. The modelled tokens' counts stay in Spark: sparse counts by token, role and output, from the
same pass, packed by blocks of tokens. They grow with the tokens modelled, and are two for each token of a text at most. With
the outputs fixed, the same loss falls apart into one convex problem for each token and role, which tasks solve in blocks of
tokens with a prior that holds vectors of little evidence near zero. The vectors are a table that grows with the tokens.

Scoring: a bounded table of the most frequent tokens, with their vectors, is sent to the tasks; rarer tokens are joined with
their counts and vectors by a shuffle and summed by text.

Nulls and ties: a null text is empty (its end alone); rows with a null id are held out; repeated rows are separate
rows; equally frequent tokens are ordered by their bytes; with no training text at all, counts are zero and every output is
equally likely; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import rows_to_batches, written

END = b""
OWN, BUCKETS = 768, 256
SENT = 300_000
HELD = 400_000
WIDTH, STEPS, NOISE = 32, 200, 10.0
LEAST, BLOCK, FITS, PRIOR = 64, 128, 30, 2.0
RUN, CELLS = 1 << 17, 1024
_COUNT = pa.schema([("token", pa.binary()), ("n", pa.int64())])
_PAIR = pa.schema([("before", pa.int32()), ("many", pa.binary())])
_PART = pa.schema([("block", pa.int32()), ("token", pa.binary()), ("cells", pa.binary()), ("many", pa.binary())])
_SHARE = pa.schema([("bucket", pa.int32()), ("mass", pa.int64()), ("tokens", pa.int64())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.struct([("token", pa.binary()), ("role", pa.int32()), ("other", pa.int32()), ("n", pa.int32())])))])
_VECTORS = pa.schema([("entity", pa.int32()), ("token", pa.binary()), ("share", pa.float64()), ("output", pa.int32()), ("context", pa.binary()), ("norm", pa.float64()), ("word", pa.binary())])
_NORM = pa.schema([("bucket", pa.int32()), ("before", pa.int32()), ("x", pa.float64())])
#: What a modelled token is counted as: what comes after it, or what it comes after.
CONTEXT, WORD = 0, 1


def tokens(text: str | None) -> list[bytes]:
    return [*text.encode().lower().split(), END] if text else [END]


def bucket(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % BUCKETS


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over a table of one text column; a task holds HELD tokens at most before it hands their counts on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > HELD:
                    yield from rows_to_batches(held.items(), _COUNT, 50_000)
                    held = Counter()
        yield from rows_to_batches(held.items(), _COUNT, 50_000)

    return texts.mapInArrow(task, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent tokens, most frequent first, and what the buckets hold."""

    words: list[bytes]
    counts: np.ndarray
    outputs: np.ndarray  # of each word
    mass: np.ndarray  # for each bucket the counts of its tokens, raised, and of the unseen
    total: int
    distinct: int

    def places(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}


def vocabulary(counts: DataFrame) -> Vocabulary:
    """At most SENT tokens reach the driver: those of the highest bins of counts that fit, and the OWN most frequent anyway,
    whatever the bins hold. Others are looked up by a join."""
    bins = counts.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count("*").alias("tokens"), F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()
    kept, least = 0, math.inf
    for r in bins:
        kept += r["tokens"]
        if kept > SENT:
            break
        least = r["bin"]
    total, distinct = sum(r["n"] for r in bins), sum(r["tokens"] for r in bins)
    found = counts.where(F.floor(F.log2("n") * 8) >= least).collect() if least < math.inf else []
    if len(found) < OWN:
        found = counts.orderBy(F.desc("n"), "token").limit(OWN).collect()
    rows = sorted(((bytes(r["token"]), r["n"]) for r in found), key=lambda r: (-r[1], r[0]))
    own = {w for w, _ in rows[:OWN]}
    sent = counts.sparkSession.sparkContext.broadcast(own)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, many = [0] * BUCKETS, [0] * BUCKETS
        for batch in batches:
            for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if token not in sent.value:
                    k = bucket(token)
                    mass[k] += n
                    many[k] += 1
        yield from rows_to_batches(zip(range(BUCKETS), mass, many), _SHARE)

    shares = counts.select("token", "n").mapInArrow(task, "bucket int, mass long, tokens long").groupBy("bucket").agg(F.sum("mass").alias("mass"), F.sum("tokens").alias("tokens")).collect()
    mass = np.full(BUCKETS, 0.1)
    for r in shares:
        mass[r["bucket"]] += r["mass"] + 0.1 * r["tokens"]
    outputs = np.array([k if k < OWN else OWN + bucket(w) for k, (w, _) in enumerate(rows)], np.int32)
    return Vocabulary([w for w, _ in rows], np.array([n for _, n in rows], np.float64), outputs, mass, total, distinct)


class Table:
    """The tokens sent, with the outputs of all."""

    def __init__(self, words: list[bytes], outputs: np.ndarray):
        self.places = {w: k for k, w in enumerate(words)}
        self.outputs = outputs
        at, ids = self.output_ids([END])
        self.end_at, self.end = int(at[0]), int(ids[0])

    def output_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each token its place in the table (-1: rarer) and its output."""
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int32, len(words))
        ids = self.outputs[at] if len(self.outputs) else np.zeros(len(at), np.int32)
        for k in np.flatnonzero(at < 0).tolist():
            ids[k] = OWN + bucket(words[k])
        return at, ids

    def run(self, texts: list[str | None]) -> Run:
        cut = [tokens(t) for t in texts]
        words = list(chain.from_iterable(cut))
        starts = np.cumsum([0, *map(len, cut)])[:-1]
        at, ids = self.output_ids(words)
        above, before = np.append(self.end_at, at[:-1]), np.append(self.end, ids[:-1])
        above[starts], before[starts] = self.end_at, self.end
        return Run(words, starts, at, ids, above, before)


@dataclass
class Run:
    """Texts cut into tokens, one text after the other: each token's place and output, and those of the token before it."""

    words: list[bytes]
    starts: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    above: np.ndarray
    before: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each text's tokens; a text has one at least, its end."""
        return np.add.reduceat(values, self.starts)

    def around(self) -> Iterator[tuple[int, bytes, int, int]]:
        """(text, token, role, output) for each place of a token that is not sent."""
        text_of = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.words))))
        for k in np.flatnonzero(self.at < 0).tolist():
            yield int(text_of[k]), self.words[k], WORD, int(self.before[k])
        first = np.zeros(len(self.words), bool)
        first[self.starts] = True
        for k in np.flatnonzero(self.above < 0).tolist():
            yield int(text_of[k]), END if first[k] else self.words[k - 1], CONTEXT, int(self.ids[k])


def in_runs(rows: Iterable[tuple], text: int = 0) -> Iterator[list[tuple]]:
    """Rows in lists whose texts have RUN characters together, the last text's beyond that included."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "") + 1
        if size >= RUN:
            yield held
            held, size = [], 0
    if held:
        yield held


def gathered(texts: DataFrame, vocab: Vocabulary, numbers: np.ndarray, more: bool) -> DataFrame:
    """(block, token, cells, many): counts of neighbours over a table of one text column, from one pass over it, in parts.

    A part with neither block nor token says how often outputs (after) follow the output -1 - ``block`` (before): its cells
    are ``after`` and ``many`` are 64 bits wide. A part of block b >= 0 tells of the modelled tokens sent whose numbers are
    b * BLOCK and the BLOCK - 1 after it, a part with a token (only if there are ``more``) of that one. Their cells are
    (k * 2 + role) * size + output, for the k-th token of the part, and ``many`` are 32 bits wide. A part has CELLS at most."""
    size = OWN + BUCKETS
    sent = texts.sparkSession.sparkContext.broadcast((vocab.words, vocab.outputs, numbers))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, outputs, numbers = sent.value
        table = Table(words, outputs)
        numbers = np.append(numbers, -1).astype(np.int64)  # the last is that of place -1
        pairs = np.zeros(size * size, np.int64)
        held: list[np.ndarray] = []
        rare: Counter = Counter()
        many = 0

        def packed(keys: np.ndarray, counts: np.ndarray, span: int) -> Iterator[tuple[int, bytes, bytes]]:
            """Sorted keys by their multiple of span."""
            of = keys // span
            ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(keys)) if len(keys) else []
            a = 0
            for b in ends:
                for k in range(a, b, CELLS):
                    part = slice(k, min(b, k + CELLS))
                    yield int(of[a]), (keys[part] - of[a] * span).astype(np.int32).tobytes(), counts[part].tobytes()
                a = int(b)

        def flush() -> Iterator[tuple]:
            found, n = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            for block, cells, times in packed(found, n.astype(np.int32), BLOCK * 2 * size):
                yield block, None, cells, times
            by_token: dict[bytes, list[tuple[int, int]]] = {}
            for (w, cell), times in rare.items():
                by_token.setdefault(w, []).append((cell, times))
            for w, cells in by_token.items():
                cells, times = np.array(sorted(cells), np.int32).T
                yield None, w, cells.tobytes(), times.tobytes()
            held.clear()
            rare.clear()

        def rows() -> Iterator[tuple]:
            nonlocal many
            texts = ((t,) for batch in batches for t in batch.column(0).to_pylist())
            for part in in_runs(texts):
                run = table.run([t for (t,) in part])
                np.add.at(pairs, run.before.astype(np.int64) * size + run.ids, 1)
                for number, role, other in ((numbers[run.at], WORD, run.before), (numbers[run.above], CONTEXT, run.ids)):
                    k = np.flatnonzero(number >= 0)
                    held.append((number[k] * 2 + role) * size + other[k])
                if more:
                    rare.update((w, role * size + o) for _, w, role, o in run.around())
                many += len(run.ids)
                if many > 2_000_000 or len(rare) > HELD:
                    yield from flush()
                    many = 0
            yield from flush()
            where = np.flatnonzero(pairs)
            for before, cells, times in packed(where, pairs[where], size):
                yield -1 - before, None, cells, times

        yield from rows_to_batches(rows(), _PART, 1000)

    return texts.mapInArrow(task, "block int, token binary, cells binary, many binary")


def pair_counts(parts: DataFrame) -> np.ndarray:
    """How often each output follows each other one."""
    size = OWN + BUCKETS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, many in zip(*(batch.column(k).to_pylist() for k in ("block", "cells", "many"))):
                total.setdefault(-1 - block, np.zeros(size, np.int64))[np.frombuffer(cells, np.int32)] += np.frombuffer(many, np.int64)
        yield from rows_to_batches(((before, n.tobytes()) for before, n in total.items()), _PAIR)

    rows = parts.where("block < 0").repartition("block").mapInArrow(task, "before int, many binary").collect()
    out = np.zeros((size, size))
    for r in rows:
        out[r["before"]] = np.frombuffer(r["many"], np.int64)
    return out


def train(pairs: np.ndarray, width: int = WIDTH, steps: int = STEPS, noise: float = NOISE, seed: int = 2) -> np.ndarray:
    """Natural log-probabilities of each output after each output, from a log-bilinear model fitted to ``pairs``."""
    context, q, b, _ = parameters(pairs, width, steps, noise, seed)
    return normalised(context @ q.T + b)


def parameters(pairs: np.ndarray, width: int = WIDTH, steps: int = STEPS, noise: float = NOISE, seed: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u = r C and q of each output, b, and the logarithm of the expected noise."""
    size = len(pairs)
    random = np.random.default_rng(seed)
    total = max(1.0, pairs.sum())
    seen = (pairs / total).astype(np.float32)
    share = pairs.sum(0) + 0.5
    share /= share.sum()
    expected = (seen.sum(1, keepdims=True) * (noise * share)[None]).astype(np.float32)
    log_noise = np.log(noise * share).astype(np.float32)
    p = {"r": random.standard_normal((size, width)) * 0.1, "c": np.eye(width), "q": random.standard_normal((size, width)) * 0.1, "b": np.log(share)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean, square = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        context = p["r"] @ p["c"]
        odds = context @ p["q"].T + p["b"] - log_noise
        true = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        slope = (seen + expected) * true - seen
        grad = {"b": slope.sum(0), "q": slope.T @ context}
        back = slope @ p["q"]
        grad |= {"r": back @ p["c"].T, "c": p["r"].T @ back}
        rate = 0.05 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-9)
    return p["r"] @ p["c"], p["q"], p["b"], log_noise


@dataclass
class Outputs:
    """The outputs' model, and what the modelled tokens' loss needs beside their own counts."""

    context: np.ndarray
    q: np.ndarray
    b: np.ndarray
    log_noise: np.ndarray
    into: np.ndarray  # how often each bucket follows each output
    mass: np.ndarray

    def after(self) -> np.ndarray:
        """The features of a word: u of the output before it, and one."""
        return np.hstack([self.context, np.ones((len(self.context), 1), np.float32)])


def modelled(vocab: Vocabulary) -> np.ndarray:
    """For each token sent its number among those that get vectors of their own, or -1."""
    own = (vocab.outputs >= OWN) & (vocab.counts >= LEAST)
    return np.where(own, np.cumsum(own) - 1, -1).astype(np.int32)


def fitted(seen: np.ndarray, expected: np.ndarray, offset: np.ndarray, features: np.ndarray) -> np.ndarray:
    """For each row the vector t that minimises its noise-contrastive loss, the log-odds being ``offset`` + t ``features``."""
    t = np.zeros((len(seen), features.shape[1]), np.float32)
    mean, square = np.zeros_like(t), np.zeros_like(t)
    scale = 1 / np.maximum(1, seen.sum(1, keepdims=True))
    both = (seen + expected) * scale
    seen = seen * scale
    down, slope = np.ascontiguousarray(-features.T), np.empty_like(seen)
    for step in range(1, FITS + 1):
        np.matmul(t, down, out=slope)
        slope -= offset
        np.exp(np.clip(slope, -30, 30, out=slope), out=slope)
        slope += 1
        np.divide(both, slope, out=slope)
        slope -= seen
        g = slope @ features + PRIOR * scale * t
        mean, square = 0.8 * mean + 0.2 * g, 0.95 * square + 0.05 * g * g
        t -= np.float32(0.2 * (1 - step / (FITS + 1))) * (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-7)
    return t.astype(np.float16)


def vectors(parts: DataFrame, counts: DataFrame, vocab: Vocabulary, numbers: np.ndarray, model: Outputs, more: bool) -> DataFrame:
    """(entity, token, share, output, context, norm, word): t_h with its normaliser's logarithm, and (v_w, a_w), of each modelled token."""
    at = np.flatnonzero(numbers >= 0)
    sent = parts.sparkSession.sparkContext.broadcast((model, vocab.counts[at], vocab.outputs[at]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts, outputs = sent.value
        size, after = len(model.b), model.after()
        noise = np.exp(model.log_noise)
        seen = np.zeros((BLOCK, 2, size), np.float32)
        flat = seen.reshape(-1)
        keys: list[tuple] = []  # (entity, token, count)

        def solved() -> Iterator[tuple]:
            n = len(keys)
            output = np.array([outputs[e] if e >= 0 else OWN + bucket(w) for e, w, _ in keys])
            share = np.array([c + 0.1 for _, _, c in keys]) / model.mass[output - OWN]
            start = model.context[output]
            as_context = np.ascontiguousarray(seen[:n, CONTEXT])
            t = fitted(as_context, as_context.sum(1, keepdims=True) * noise, start @ model.q.T + model.b - model.log_noise, model.q)
            scores = ((start + t) @ model.q.T + model.b).astype(np.float64)
            top = scores.max(1)
            norm = top + np.log(np.exp(scores - top[:, None]).sum(1))
            expected = (NOISE * share[:, None] * model.into.T[output - OWN]).astype(np.float32)
            v = fitted(np.ascontiguousarray(seen[:n, WORD]), expected, np.float32(-math.log(NOISE)), after)
            for k, (e, w, _) in enumerate(keys):
                yield e, w, float(share[k]), int(output[k]), t[k].tobytes(), float(norm[k]), v[k].tobytes()
            seen[:] = 0
            keys.clear()

        def rows() -> Iterator[tuple]:
            last = None
            for batch in batches:
                for block, token, cells, many, c in zip(*(batch.column(k).to_pylist() for k in ("block", "token", "cells", "many", "c"))):
                    if (block, token) != last:
                        if keys and (token is None or len(keys) == BLOCK):
                            yield from solved()
                        if token is None:
                            first = block * BLOCK
                            keys.extend((e, None, counts[e]) for e in range(first, min(first + BLOCK, len(counts))))
                        else:
                            keys.append((-1, token, c))
                        last = block, token
                    shift = 0 if token is None else (len(keys) - 1) * 2 * size
                    flat[np.frombuffer(cells, np.int32) + shift] += np.frombuffer(many, np.int32)
            if keys:
                yield from solved()

        yield from rows_to_batches(rows(), _VECTORS)

    mine = parts.where("block >= 0").withColumn("c", F.lit(None).cast("long"))
    if more:
        mine = mine.unionByName(parts.where("token is not null").join(counts.where(F.col("n") >= LEAST).select("token", F.col("n").alias("c")), "token"))
    # Tokens come first: nulls of a sorted column do.
    sorted_parts = mine.repartition("block", "token").sortWithinPartitions("block", "token")
    return sorted_parts.mapInArrow(task, "entity int, token binary, share double, output int, context binary, norm double, word binary")


def unpacked(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, width).astype(np.float32)


def bucket_norms(found: DataFrame, model: Outputs) -> np.ndarray:
    """For each output before it and each bucket, the logarithm of the sum of share(w) exp(u_c v_w + a_w) over its tokens."""
    sent = found.sparkSession.sparkContext.broadcast(model.after())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = sent.value
        total = np.zeros((BUCKETS, len(after)))
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                more = np.expm1((unpacked(part.column("word"), after.shape[1]) @ after.T).astype(np.float64)) * part.column("share").to_numpy()[:, None]
                np.add.at(total, part.column("output").to_numpy() - OWN, more)
        where = np.argwhere(total)
        yield from rows_to_batches(((int(b), int(c), float(total[b, c])) for b, c in where), _NORM, 50_000)

    rows = found.select("share", "output", "word").mapInArrow(task, "bucket int, before int, x double").groupBy("bucket", "before").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((len(model.b), BUCKETS))
    out[rows.column("before").to_numpy(), rows.column("bucket").to_numpy()] = rows.column("x").to_numpy()
    return np.log1p(out)


def normalised(scores: np.ndarray) -> np.ndarray:
    scores = scores.astype(np.float64)
    scores -= scores.max(1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(1, keepdims=True))


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    training = rows.where("not held_out").select("text")
    counts = written(token_counts(training), "token-counts")
    vocab = vocabulary(counts)
    numbers = modelled(vocab)
    more = counts.where(F.col("n") >= LEAST).count() > int((vocab.counts >= LEAST).sum())
    parts = written(gathered(training, vocab, numbers, more), "neighbours")
    pairs = pair_counts(parts)
    model = Outputs(*parameters(pairs), pairs[:, OWN:].astype(np.float32), vocab.mass)
    table = normalised(model.context @ model.q.T + model.b) / math.log(10)
    found = written(vectors(parts, counts, vocab, numbers, model, more), "vectors")
    norms = bucket_norms(found, model) / math.log(10)
    log_all = math.log10(vocab.total + 0.1 * (vocab.distinct + 1))
    raised = np.log10(vocab.counts + 0.1)
    inside = np.where(vocab.outputs < OWN, 0.0, raised - np.log10(vocab.mass)[np.maximum(0, vocab.outputs - OWN)])
    mine = found.where("entity >= 0").select("entity", "context", "norm", "word").toArrow().sort_by("entity")
    known = mine.column("entity").to_numpy()
    index = np.full(int(numbers.max(initial=-1)) + 2, -1, np.int32)  # the last is that of number -1
    index[known] = np.arange(len(known))
    vectors_sent = index[numbers], unpacked(mine.column("context"), WIDTH).astype(np.float16), mine.column("norm").to_numpy(), unpacked(mine.column("word"), WIDTH + 1).astype(np.float16)
    sent = docs.sparkSession.sparkContext.broadcast((vocab.words, vocab.outputs, raised, inside, -np.log10(vocab.mass), table, norms, model, vectors_sent))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, outputs, raised, inside, outside, table, norms, model, (numbers, contexts, norm, word) = sent.value
        cut = Table(words, outputs)
        # What place -1 adds is told by the tokens' buckets and by a join.
        numbers, raised, inside = np.append(numbers, -1), np.append(raised, 0.0), np.append(inside, 0.0)
        after = model.after()

        def gained(run: Run) -> np.ndarray:
            """What each token adds to the score, some at a time."""
            out = np.empty(len(run.ids))
            for a in range(0, len(out), 1 << 15):
                part = slice(a, a + (1 << 15))
                at, ids, before = run.at[part], run.ids[part], run.before[part]
                g = table[before, ids] + inside[at]
                if (k := np.flatnonzero(at < 0)).size:
                    g[k] += outside[ids[k] - OWN]
                if (k := np.flatnonzero(ids >= OWN)).size:
                    g[k] -= norms[before[k], ids[k] - OWN]
                above, number = numbers[run.above[part]], numbers[at]
                if (k := np.flatnonzero(above >= 0)).size:
                    g[k] += context_gain(contexts[above[k]], norm[above[k]], before[k], ids[k], model, table)
                if (k := np.flatnonzero(number >= 0)).size:
                    g[k] += word_gain(word[number[k]], before[k], after)
                out[part] = g
            return out

        def rows() -> Iterator[tuple]:
            for part in in_runs((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), 1):
                run = cut.run([text for _, text, _ in part])
                rare: dict[int, Counter] = {}
                for k, w, role, o in run.around():
                    if more or role == WORD:
                        rare.setdefault(k, Counter())[w, role, o if more else 0] += 1
                lengths = np.diff(np.append(run.starts, len(run.ids))).tolist()
                sums = (run.sums((run.at >= 0).astype(np.int64)), run.sums(raised[run.at]), run.sums(gained(run)))
                for k, ((doc, _, out), n, known, base, total) in enumerate(zip(part, lengths, *(x.tolist() for x in sums))):
                    yield doc, out, n, known, base, total, [{"token": w, "role": role, "other": o, "n": n} for (w, role, o), n in rare.get(k, {}).items()]

        yield from rows_to_batches(rows(), _SCORED, 1024)

    scored = rows.select("doc_id", "text", "held_out").mapInArrow(task, "doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<struct<token:binary,role:int,other:int,n:int>>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("t")).select("row", "t.token", "t.role", "t.other", "t.n").join(counts.withColumnRenamed("n", "c"), "token", "left")
    as_word = F.col("role") == WORD
    adds = F.when(as_word, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).otherwise(0.0)
    rare = rare.withColumn("s", adds).withColumn("k", F.when(as_word & (F.col("c") > 0), F.col("n")).otherwise(0))
    if more:
        rare = gains(rare.join(found.where("entity < 0").select("token", "output", "context", "norm", "word"), "token", "left"), model, table)
    else:
        rare = rare.select("row", "s", "k", F.lit(0.0).alias("g"))
    sums = rare.groupBy("row").agg(F.sum("s").alias("s"), F.sum("k").alias("k"), F.sum("g").alias("g"))
    out = scored.drop("rare").join(sums, "row", "left")
    extra = F.coalesce("s", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * log_all).alias("base_score"), (F.col("model") + extra + F.coalesce("g", F.lit(0.0))).alias("score"),
    )


def context_gain(t: np.ndarray, norm: np.ndarray, before: np.ndarray, after: np.ndarray, model: Outputs, table: np.ndarray) -> np.ndarray:
    """Decimal log-probabilities of the outputs ``after`` contexts with vectors of their own, less those after the contexts' outputs."""
    scores = np.einsum("ij,ij->i", model.context[before] + t, model.q[after]) + model.b[after] - norm
    return scores / math.log(10) - table[before, after]


def word_gain(v: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", after[before], v.astype(np.float32)) / math.log(10)


def gains(rare: DataFrame, model: Outputs, table: np.ndarray) -> DataFrame:
    """(row, s, k, g): what their vectors add to the score of tokens that are not sent."""
    sent = rare.sparkSession.sparkContext.broadcast((model, table))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = sent.value
        after = model.after()
        for batch in batches:
            role, other, n = (batch.column(k).to_numpy() for k in ("role", "other", "n"))
            has = batch.column("context").is_valid().to_numpy(zero_copy_only=False)
            g = np.zeros(len(role))
            for kind in (CONTEXT, WORD):
                if (k := np.flatnonzero(has & (role == kind))).size:
                    part = batch.take(pa.array(k))
                    if kind == CONTEXT:
                        g[k] = n[k] * context_gain(unpacked(part.column("context"), WIDTH), part.column("norm").to_numpy(), part.column("output").to_numpy(), other[k], model, table)
                    else:
                        g[k] = n[k] * word_gain(unpacked(part.column("word"), WIDTH + 1), other[k], after)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("s"), batch.column("k"), pa.array(g)], names=["row", "s", "k", "g"])

    return rare.select("row", "s", "k", "role", "other", "n", "output", "context", "norm", "word").mapInArrow(task, "row long, s double, k int, g double")
