"""Decontamination of shared and missing ids and of repeated passages, and personal data found over many hops."""

import random
import time

import corpus_pipeline
from callweave.llm import decontaminate, personal
from tests.llm import brute

WORDS = [f"w{k}" for k in range(300)]
ITEMS = "item_id long, text string"


def passage(chosen, n):
    return " ".join(chosen.choice(WORDS) for _ in range(n))


def test_rows_are_judged_by_their_texts(spark, tmp_path):
    """Rows that share an id, or have none: those with a leaked passage go, the others stay."""
    chosen = random.Random(31)
    item = passage(chosen, 40)
    spark.createDataFrame([(1, item)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    leaked, clean = f"{passage(chosen, 30)} {item} {passage(chosen, 30)}", passage(chosen, 100)
    rows = [(1, clean), (1, leaked), (2, leaked), (None, leaked), (None, leaked), (None, clean), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "h", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, text_hash string, start int").repartition(3)
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, clean), (None, clean), (3, None), (4, "")], key=str)
    found = decontaminate.find(docs, spark.createDataFrame([(1, item)], ITEMS))
    assert sorted(((r.doc_id, r.item_id, r.similarity, r.start) for r in found.collect()), key=str) == [(1, 1, 1.0, 30), (2, 1, 1.0, 30)]


def test_a_text_that_repeats_a_passage(spark):
    """Work follows the words, not the words times the windows."""
    chosen = random.Random(32)
    item = passage(chosen, 40)
    texts = [(1, " ".join([item] * 500)), (2, " ".join("same" for _ in range(20_000)))]
    items = [(1, item), (2, " ".join("same" for _ in range(50))), (3, passage(chosen, 60))]
    docs, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    decontaminate.find(docs.limit(0), marks).collect()  # compiles
    began = time.monotonic()
    got = decontaminate.find(docs, marks).collect()
    assert time.monotonic() - began < 60
    assert sorted((r.doc_id, r.item_id, r.similarity, r.start) for r in got) == [(1, 1, 1.0, 0), (2, 2, 1.0, 0)]


def test_many_items_in_many_texts(spark):
    """Random edits of passages, against all windows."""
    chosen = random.Random(33)
    items = {k: passage(chosen, n) for k, n in enumerate((5, 7, 12, 30, 30, 61))}
    texts = {}
    for k in range(60):
        w = items[chosen.randrange(6)].split(" ")
        for _ in range(chosen.randrange(len(w) // 6 + 1)):
            w[chosen.randrange(len(w))] = chosen.choice(WORDS)
        texts[k] = " ".join([passage(chosen, 20), *w, passage(chosen, 20), *chosen.choice([[], w[: len(w) // 2]])])
    found = decontaminate.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), ITEMS), radius=64 - 1).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in found}
    want = {(d, i): best for d, t in texts.items() for i, x in items.items() if (best := brute.weighted_windows(t, x, 0.8))}
    assert got == want and len(want) >= 20


def hops(chosen, n, each=8):
    """Seeds stand after one phrase; the values of a hop after that of the hop before them, and often after their own."""
    rows = [f"please ring number +49 30 {chosen.randrange(1000000, 9999999)} today" for _ in range(60)]
    known = [[f"x{k:02d}-{chosen.randrange(1000, 9999)}q{v}" for v in range(each)] for k in range(n)]
    for k, values in enumerate(known):
        before = "please ring number" if not k else f"code{k} stands for{k}"
        rows += [f"{before} {v} end{k}" for v in values] + [f"code{k + 1} stands for{k + 1} {v} stop{k}{m}" for v in values for m in range(6)]
    return rows + ["the year 123456789 was long", "in 1999 and 2001"], known


def test_chains_of_any_length(spark):
    rows, known = hops(random.Random(34), 12)
    found = personal.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    got = {rows[r.doc_id][s.start : s.end] for r in found for s in r.spans if s.kind == 4}
    assert got == {v for values in known for v in values} == brute.contexts(rows)


def test_contexts_are_those_of_the_plain_version(spark):
    """Random texts of few words, numbers of several shapes, long words and long gaps."""
    chosen = random.Random(35)
    shapes = ["+49 30 1234567", "a.b@c.de", "DE89370400440532", "B-AB-1234", "X123456", "12-34-56", "1999", "v2", "4111 1111 1111 1111", "x" * 60 + "123"]
    words = ["call", "Number", "id", "and", "\n", "ref:", "y" * 70, "(see)"]
    texts = [" ".join(chosen.choice(shapes if chosen.random() < 0.3 else words) for _ in range(chosen.randrange(1, 40))) for _ in range(300)]
    found = personal.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), support=1, share=0.3, least=0.6).collect()
    got = {texts[r.doc_id][s.start : s.end] for r in found for s in r.spans if s.kind == 4}
    assert got == brute.contexts(texts, support=1, share=0.3, least=0.6) and got
