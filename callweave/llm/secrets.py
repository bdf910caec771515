"""Operator 4: secrets, by fixed patterns and by a battery of randomness tests.

``scan`` reads every whole text once and finds the base kinds (assign, access, hex) and the candidates: runs of at least
``LEAST`` letters, digits and ``+/_-``, with padding. For each candidate the encoding is inferred (the smallest alphabet
that holds it) and three tests ask whether its symbols look drawn at random from that alphabet: chi-squared uniformity
over equal bins of the alphabet, the number of runs above and below the alphabet's middle, and the serial correlation of
neighbours. Fisher's method combines them; the result is kept as a tenth of its negative decimal logarithm (0: random).

``thresholds`` controls the share of false discoveries for each band of lengths. How often ordinary text of that length
passes for random is told by all letters between the candidates of every text, written together and cut into stretches of
the band's least length. A band's threshold is the most lenient one at which that rate, times the band's candidates, is at
most ``rate`` times the candidates found. A short string must thus look better than a long one, and a band without enough
evidence finds nothing. Letters of one case, perhaps after one capital, are bands of their own: they may be long words, so
they are held against stretches of one case under the same alphabet of 26, and a string that occurs often counts once. The
stretches are counted by band and value, and only a table of bands by values, of a fixed size, reaches the driver.

Nulls and ties: a null text counts as empty; a null id is kept; repeated rows are separate rows; an empty table gives an
empty result. Spans are in code points, ends excluded, ordered by start, then by kind. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import written

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]
HINTS = ("passw", "secret", "token", "apikey", "api_key")

LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
TITLE = re.compile(r"[A-Z][a-z]+")
ONE_CASE = ("lower26", "upper26")
ALPHABETS = {
    "decimal": "0123456789", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower26": "abcdefghijklmnopqrstuvwxyz", "upper26": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base32": "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz", "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", "mixed": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
PLACES = {name: {c: k for k, c in enumerate(a)} for name, a in ALPHABETS.items()}
BANDS = (20, 24, 32, 48, 64, 128)
NO_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)
WORST = 60
SCANNED = "doc_id long, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,band:int,value:int,encoding:string,name:long>>, plain array<struct<band:int,value:int,n:long>>"
BLOCK = 1 << 19


def chi_squared_tail(x: float, df: int) -> float:
    """Wilson-Hilferty's approximation."""
    if df <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(token: str) -> str:
    held = set(token)
    return next(name for name, places in PLACES.items() if held <= places.keys())


def bins_of(size: int, n: int) -> int:
    """Bins with five symbols each in expectation; of letters of one case each is a bin, because prose differs there most."""
    return size if size == 26 else max(2, min(size, n // 5))


def battery(token: str) -> tuple[str, float]:
    """The inferred encoding, and the combined p-value of the three tests; small: not random."""
    token = token.rstrip("=")
    encoding = infer(token)
    places, size = PLACES[encoding], len(ALPHABETS[encoding])
    values = [places[c] for c in token]
    n = len(values)
    bins = bins_of(size, n)
    counts, width = [0] * bins, [0] * bins
    for v in range(size):
        width[v * bins // size] += 1
    for v in values:
        counts[v * bins // size] += 1
    uniform = chi_squared_tail(sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, width)), bins - 1)
    high = [v >= size / 2 for v in values]
    above = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    share = sum(v >= size / 2 for v in range(size)) / size
    mean, spread = 1 + (n - 1) * 2 * share * (1 - share), math.sqrt((n - 1) * 0.25)
    alternating = math.erfc(abs(runs - mean) / spread / math.sqrt(2)) if above not in (0, n) else math.erfc((mean - 1) / spread / math.sqrt(2))
    middle = sum(values) / n
    variance = sum((v - middle) ** 2 for v in values)
    serial = math.erfc(abs(sum((a - middle) * (b - middle) for a, b in zip(values, values[1:])) / variance) * math.sqrt(n) / math.sqrt(2)) if variance else 0.0
    joint = -2 * sum(math.log(max(p, 1e-12)) for p in (uniform, alternating, serial))
    return encoding, math.exp(-joint / 2) * (1 + joint / 2 + joint * joint / 8)


def value(p: float) -> int:
    return min(WORST, int(-10 * math.log10(max(p, 1e-12))))


def band(length: int) -> int:
    return sum(length >= b for b in BANDS) - 1


#: For letters alone the alphabets that infer() can choose, smallest first, as tables of the places of bytes (-1: not held).
LETTERS = [(len(ALPHABETS[name]), np.array([PLACES[name].get(chr(b), -1) for b in range(256)], np.int16)) for name in ALPHABETS]
#: The same without the alphabets of one case, and those alone.
WIDE = [t for t, name in zip(LETTERS, ALPHABETS) if name not in ONE_CASE]
NARROW = [t for t, name in zip(LETTERS, ALPHABETS) if name in ONE_CASE]


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii", "ignore").translate(None, NO_LETTERS), np.uint8)


def tails(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) for v in x.tolist()])


def batteries(rows: np.ndarray, alphabets: list = LETTERS) -> np.ndarray:
    """The p-values that battery() gives for ``rows`` of letters of one length, the smallest of ``alphabets`` being inferred."""
    out, left = np.full(len(rows), np.nan), np.ones(len(rows), bool)
    n = rows.shape[1]
    for size, table in alphabets:
        at = np.flatnonzero(left)
        if not len(at):
            break
        values = table[rows[at]]
        fits = (values >= 0).all(1)
        at, values = at[fits], values[fits]
        left[at] = False
        if not len(at):
            continue
        bins = bins_of(size, n)
        width = np.bincount(np.arange(size) * bins // size, minlength=bins)
        cells = (np.arange(size) * bins // size)[values] + np.arange(len(at))[:, None] * bins
        counts = np.bincount(cells.ravel(), minlength=len(at) * bins).reshape(-1, bins)
        x, df = ((counts - n * width / size) ** 2 / (n * width / size)).sum(1), bins - 1
        uniform = 0.5 * tails(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2))
        high = values >= size / 2
        above = high.sum(1)
        runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
        share = sum(v >= size / 2 for v in range(size)) / size
        mean, spread = 1 + (n - 1) * 2 * share * (1 - share), math.sqrt((n - 1) * 0.25)
        by_runs = tails(np.abs(np.arange(n + 1) - mean) / spread / math.sqrt(2))
        alternating = np.where((above == 0) | (above == n), math.erfc((mean - 1) / spread / math.sqrt(2)), by_runs[runs])
        apart = values - values.mean(1, keepdims=True)
        variance = (apart * apart).sum(1)
        serial = np.where(variance > 0, tails(np.abs((apart[:, :-1] * apart[:, 1:]).sum(1) / np.where(variance > 0, variance, 1)) * math.sqrt(n) / math.sqrt(2)), 0.0)
        joint = -2 * sum(np.log(np.maximum(p, 1e-12)) for p in (uniform, alternating, serial))
        out[at] = np.exp(-joint / 2) * (1 + joint / 2 + joint * joint / 8)
    return out


def add_stretches(texts: list[np.ndarray], total: np.ndarray, one_case: bool = False) -> None:
    """Add to ``total``, bands by values, what the stretches of each text's letters give; none crosses two texts. With
    ``one_case`` only stretches of one case count, under the alphabet of that case, else all, under wider ones."""
    for k, length in enumerate(BANDS):
        cut = [t[: len(t) // length * length] for t in texts]
        rows = np.concatenate(cut).reshape(-1, length) if cut else np.zeros((0, length), np.uint8)
        if one_case:
            small = rows >= ord("a")
            rows = rows[small.all(1) | ~small.any(1)]
        for a in range(0, len(rows), BLOCK // length):
            p = batteries(rows[a : a + BLOCK // length], NARROW if one_case else WIDE)
            found = np.minimum(WORST, (-10 * np.log10(np.maximum(p, 1e-12))).astype(int))
            total[k] += np.bincount(found, minlength=WORST + 1)[: WORST + 1]


def scan_text(text: str) -> tuple[list, list, np.ndarray]:
    """Base spans (start, kind, end), candidates outside them (start, end, band, value, encoding, name), and the letters
    between the candidates. ``name`` is a hash of the candidate where that counts once however often it occurs."""
    base = []
    low = text.lower()
    if any(h in low for h in HINTS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    found, between, last = [], [], 0
    for m in CANDIDATE.finditer(text):
        token = m[0]
        between.append(text[last : m.start()])
        last = m.end()
        if any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        encoding, p = battery(token.lower() if TITLE.fullmatch(token) else token)
        once = encoding in ONE_CASE
        name = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True) if once else None
        found.append((m.start(), m.end(), band(len(token)) + once * len(BANDS), value(p), encoding, name))
    return base, found, letters("".join(between) + text[last:])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its base spans, and its candidates with the tests' results.

    How often stretches of plain letters have each result is summed by batch, and stands in the batch's first row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, held, many, total = [], [], 0, np.zeros((2 * len(BANDS), WORST + 1), np.int64)

            def count() -> None:
                add_stretches(held, total[: len(BANDS)])
                add_stretches(held, total[len(BANDS) :], True)
                held.clear()

            for text in batch.column(1).to_pylist():
                *row, plain = scan_text(text or "")
                rows.append(row)
                held.append(plain)
                many += len(plain)
                if many >= BLOCK:
                    count()
                    many = 0
            count()
            counted = [{"band": int(k), "value": int(v), "n": int(total[k, v])} for k, v in np.argwhere(total)]
            sums = pa.array([counted, *[[]] * (len(rows) - 1)], pa.list_(pa.struct([("band", pa.int32()), ("value", pa.int32()), ("n", pa.int64())])))
            base = pa.array([[dict(zip(("start", "kind", "end"), s)) for s in r[0]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])))
            fields = [("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("value", pa.int32()), ("encoding", pa.string()), ("name", pa.int64())]
            found = pa.array([[dict(zip((f for f, _ in fields), s)) for s in r[1]] for r in rows], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), base, found, sums], names=["doc_id", "base", "found", "plain"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, SCANNED)


def thresholds(scanned: DataFrame, rate: float = 0.05) -> list[int]:
    """For each band, then for each band of one case, the largest value that counts as random; -1: none."""
    each = scanned.select(F.explode("found").alias("x")).select("x.band", "x.value", "x.name")
    once = each.where("name is not null").distinct().unionByName(each.where("name is null"))
    found = {(r[0], r[1]): r[2] for r in once.groupBy("band", "value").count().collect()}
    plain = {(r[0], r[1]): r[2] for r in scanned.select(F.explode("plain").alias("x")).groupBy("x.band", "x.value").agg(F.sum("x.n").alias("n")).collect()}
    out = []
    for k in range(2 * len(BANDS)):
        null = [plain.get((k, v), 0) for v in range(WORST + 1)]
        seen = [found.get((k, v), 0) for v in range(WORST + 1)]
        best = -1
        for v in range(WORST + 1):
            passed = sum(seen[: v + 1])
            chance = (1 + sum(null[: v + 1])) / (1 + sum(null))
            if passed and chance * sum(seen) <= rate * passed and chance < 1:
                best = v
        out.append(best)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """doc_id, spans: array of (start, kind, end), base kinds and the kind ``random``; kinds are numbered as in KINDS."""
    scanned = written(scan(docs, id_col, text_col), "secrets")
    limits = F.array(*[F.lit(x) for x in thresholds(scanned, rate)])
    random = F.transform(F.filter("found", lambda x: x["value"] <= F.element_at(limits, x["band"] + 1)), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return scanned.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
