"""Operator 7: personal data, by fixed patterns and by patterns learned from their contexts. DataFrame functions only.

``extract`` finds the base kinds (email, ip, card, phone) in every whole text, with their places in code points, and the
candidates: other tokens of letters, digits and ``_./:-``, of four characters or more, with a digit among the first sixteen
and three digits at least; they need not begin with one. The base entities are seeds. Each entity and candidate has up to
three lexical patterns: the word before it, the two words before it, and the word after it, all of them whole words.

``bootstrap`` scores the graph of patterns and values in rounds. Seeds are sure. A pattern counts if ``support`` different
sure values occur with it and they make up ``share`` of its occurrences; its confidence is then s / (s + 1), s being the
occurrences of sure values: the limit to which the pattern and the values that it alone supports confirm each other. A value's
confidence is the largest of its patterns', and it is sure from ``least`` on, so what a pattern finds can induce further
patterns. Confidences follow from the sure values alone: rounds go on until none becomes sure, and then nothing moves any more.
There is no limit of rounds unless one is given. Candidates that are sure are identifiers found, of the kind ``context``.

Places are sums of lengths, taken in blocks of the root of their number, and a redacted text is cut from pieces of
``PIECE`` characters: work grows little faster than the text, also where it holds tens of thousands of matches.

The regular expressions below match exactly what the base kinds say, written so that the engine neither backtracks over
long runs nor recurses: runs are possessive and start where a run starts or where the last match ended.

Nulls and ties: a null text counts as empty; a null id is kept; repeated rows are separate rows; empty tables give an
empty result; other columns are left out. Spans are ordered by kind, then by start; ends are excluded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import bound, written

KINDS = ["email", "ip", "card", "phone", "context"]
# Fixed patterns of the base kinds.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
AT_MOST_255 = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CANDIDATE = r"(?<![0-9A-Za-z])(?=[A-Za-z_./:-]{0,15}[0-9](?:[A-Za-z_./:-]*+[0-9]){2})[0-9A-Za-z][0-9A-Za-z_./:-]{2,}[0-9A-Za-z]"
PIECE = 1000
NEAR = 48  # characters around a match that are enough for its neighbours if they hold whole words; if not, all are taken
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
TWO_BEFORE, ONE_AFTER = f"{SPACE}{WORD}+{SPACE}+{WORD}+{SPACE}*$", f"^{SPACE}*{WORD}+{SPACE}"
ROW = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(number)
    at = lambda i: F.substring(back, i, 1).cast("int")
    twice = lambda i: F.when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda n, i: n + F.when(i % 2 == 0, twice(i)).otherwise(at(i)))
    return total % 10 == 0


def running(values: Column, zero: Column, merge) -> Column:
    """For each element of an array what ``merge``, an associative function, makes of those before it, from ``zero`` on.

    Blocks of the root of the length are folded first, then the blocks' results, then each block from what precedes it."""

    def fold(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, first, lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def whole(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda j: F.slice(v, j * step + 1, step))
        return bound(parts, lambda p: bound(fold(F.transform(p, lambda x: F.aggregate(x, zero, merge)), zero), lambda starts: F.flatten(F.zip_with(p, starts, fold))))

    return bound(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def near(gap: Column, side, words: str) -> Column:
    """The end of a gap beside a match, long enough for the whole words that patterns take."""
    end = side(gap, F.lit(NEAR))
    return F.when((F.length(gap) <= NEAR) | end.rlike(words), end).otherwise(gap)


def located(text: Column, pattern: str, possible: Column) -> Column:
    """The leftmost matches that do not overlap, with places and surroundings; the text is cut only if there are any."""
    none = F.array().cast(ROW)

    def rows(s: Column) -> Column:
        found, gaps = s["found"], s["gaps"]
        before = running(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), F.lit(0), lambda a, b: a + b)

        def row(at: Column, i: Column) -> Column:
            start = at + F.length(F.get(gaps, i))
            return F.struct(start.alias("start"), (start + F.length(F.get(found, i))).alias("end"), F.get(found, i).alias("value"), near(F.get(gaps, i), F.right, TWO_BEFORE).alias("before"), near(F.get(gaps, i + 1), F.left, ONE_AFTER).alias("after"))

        return F.transform(before, row)

    found = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return bound(found, lambda f: F.when(F.size(f) > 0, bound(F.struct(f.alias("found"), F.split(text, pattern, -1).alias("gaps")), rows)).otherwise(none))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row for each document: row (unique once written), doc_id, base (with kind), candidates, and with ``carry`` all
    columns of ``docs`` as the struct doc."""
    text = F.col("text")
    doc = F.struct(*[F.col(c) for c in docs.columns]) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), doc.alias("doc"))
    number = text.rlike("[0-9]")
    rows = rows.select("doc_id", "doc", located(text, EMAIL, F.contains(text, F.lit("@"))).alias("e"), located(text, IP, number).alias("i"), located(text, CARD, number).alias("c"), located(text, PHONE, F.contains(text, F.lit("+"))).alias("p"), located(text, CANDIDATE, number).alias("o"))
    length = lambda m: F.length(digits(m["value"]))
    kept = {
        "e": lambda m: F.lit(True),
        "i": lambda m: m["value"].rlike(rf"^(?:{AT_MOST_255}\.){{3}}{AT_MOST_255}$"),
        "c": lambda m: F.when(length(m).between(13, 19), luhn(digits(m["value"]))).otherwise(F.lit(False)),
        "p": lambda m: length(m).between(9, 15),
    }
    named = lambda k: lambda m: m.withField("kind", F.lit(k))
    base = [F.transform(F.filter(name, test), named(k)) for k, (name, test) in enumerate(kept.items())]
    rows = rows.select("doc_id", "doc", "o", F.concat(*base).alias("base"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "doc", "base", apart(F.col("o"), F.col("base")).alias("candidates"))


def apart(rows: Column, base: Column) -> Column:
    """The matches of ``rows`` that overlap none of ``base``: in the order of starts, the furthest end before a match and
    the nearest start after it tell."""
    last = F.lit((1 << 31) - 1)
    sided = lambda m, side: F.struct(m["start"].alias("start"), F.lit(side).alias("side"), m["end"].alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after"))
    both = F.array_sort(F.concat(F.transform(base, lambda m: sided(m, 0)), F.transform(rows, lambda m: sided(m, 1))))

    def kept(e: Column) -> Column:
        ends = running(F.transform(e, lambda m: F.when(m["side"] == 0, m["end"]).otherwise(F.lit(0))), F.lit(0), lambda a, b: F.greatest(a, b))
        starts = F.reverse(running(F.transform(F.reverse(e), lambda m: F.when(m["side"] == 0, m["start"]).otherwise(last)), last, lambda a, b: F.least(a, b)))
        near = F.arrays_zip(e.alias("m"), ends.alias("end"), starts.alias("start"))
        free = F.filter(near, lambda x: (x["m"]["side"] == 1) & (x["end"] <= x["m"]["start"]) & (x["start"] >= x["m"]["end"]))
        return F.transform(free, lambda x: F.struct(*[x["m"][f].alias(f) for f in ("start", "end", "value", "before", "after")]))

    return bound(rows, lambda r: F.when((F.size(r) > 0) & (F.size(base) > 0), bound(both, kept)).otherwise(r))


def patterns(m: Column) -> Column:
    """The lexical patterns of a match: word before, two words before, word after."""
    word = f"{WORD}+"
    before, after = F.regexp_extract_all(F.lower(m["before"]), F.lit(word), F.lit(0)), F.regexp_extract(F.lower(m["after"]), word, 0)
    last, previous = F.element_at(before, -1), F.try_element_at(before, F.lit(-2))
    made = F.array(F.when(F.size(before) > 0, F.concat(F.lit("1 "), last)), F.when(F.size(before) > 1, F.concat(F.lit("2 "), previous, F.lit(" "), last)), F.when(after != "", F.concat(F.lit("+ "), after)))
    return F.filter(made, lambda x: x.isNotNull())


def bootstrap(found: DataFrame, rounds: int | None = None, support: int = 5, least: float = 0.9, share: float = 0.5) -> DataFrame:
    """The candidate values (value, confidence) that reach ``least``."""
    both = F.concat(F.transform("base", lambda m: F.struct(m["value"].alias("value"), F.lit(True).alias("seed"), patterns(m).alias("patterns"))), F.transform("candidates", lambda m: F.struct(m["value"].alias("value"), F.lit(False).alias("seed"), patterns(m).alias("patterns"))))
    seen = found.where("size(candidates) + size(base) > 0").select(F.explode(both).alias("m")).select("m.value", "m.seed", F.explode("m.patterns").alias("pattern"))
    pairs = seen.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.bool_or("seed").alias("seed"), F.bool_or(~F.col("seed")).alias("other"))
    pairs = written(pairs, "contexts")
    sure, last = pairs.where("seed").select("value").distinct(), None
    done = 0
    while rounds is None or done < rounds:
        weights = trusted(pairs, sure, support, share).where(F.col("weight") >= least)
        reached = pairs.join(weights, "pattern").groupBy("value").agg(F.max("weight").alias("confidence"))
        last = written(reached, "confidence")
        new = written(last.join(sure, "value", "left_anti").select("value"), "sure")
        if new.isEmpty():
            break
        sure, done = written(sure.union(new), "sure"), done + 1
    if last is None:
        last = found.sparkSession.createDataFrame([], "value string, confidence double")
    return last.join(pairs.where("other").select("value").distinct(), "value", "left_semi")


def trusted(pairs: DataFrame, sure: DataFrame, support: int, share: float) -> DataFrame:
    """(pattern, weight) of the patterns that count, given the sure values."""
    marked = pairs.join(sure.withColumn("sure", F.lit(True)), "value", "left")
    held = F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0))
    sums = marked.groupBy("pattern").agg(F.sum("n").alias("n"), held.alias("held"), F.count_if("sure").alias("values"))
    return sums.where((F.col("values") >= support) & (F.col("held") >= share * F.col("n"))).select("pattern", (F.col("held") / (F.col("held") + 1)).alias("weight"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, support: int = 5, least: float = 0.9, carry: bool = False, share: float = 0.5) -> DataFrame:
    """doc_id, spans: array of (kind, start, end), kinds numbered as in KINDS; with ``carry`` also doc, as in ``extract``."""
    found = written(extract(docs, id_col, text_col, carry), "personal")
    sure = bootstrap(found, rounds, support, least, share).select("value")
    more = found.where("size(candidates) > 0").select("row", F.explode("candidates").alias("m")).select("row", "m.value", "m.start", "m.end").join(sure, "value", "left_semi")
    more = more.groupBy("row").agg(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end")).alias("more"))
    base = F.transform("base", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    spans = F.concat(base, F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    return found.join(more, "row", "left").select("doc_id", "doc", F.array_sort(spans).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans found in its text replaced by their kinds."""
    found = find(docs, id_col, text_col, carry=True).withColumn("text", F.col("doc")[text_col].cast("string"))
    return found.withColumn("clean", redacted("text", "spans")).select(*[F.col("clean").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])


def redacted(text: str, spans: str) -> Column:
    """The text with each stretch that spans cover replaced by the first one's kind in angle brackets.

    Spans are taken in the order of their starts; one that starts inside what is replaced adds to it.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def clean(s: Column) -> Column:
        spans, pieces = s["spans"], s["pieces"]

        def cut(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            near = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(near, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))

        before = running(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        parts = F.zip_with(spans, before, lambda x, at: F.when(x["start"] >= at, F.concat(cut(at, x["start"]), F.element_at(names, x["kind"] + 1))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), cut(F.array_max(F.transform(spans, lambda x: x["end"])), F.length(F.col(text))))

    return F.when(F.size(spans) > 0, bound(F.struct(ordered.alias("spans"), pieces.alias("pieces")), clean)).otherwise(F.col(text))
