"""Joins, near duplicates, decontamination and models, against brute force or held-out rows."""

import math
import random
import zlib

import numpy as np
import pytest

from callweave.llm import decontaminate, embeddings, jaccard, language, lm, queries
from tests.conftest import DATA
from tests.llm import brute

WORDS = [f"w{k}" for k in range(300)]


def varied(chosen, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        at = chosen.randrange(len(w))
        w[at : at + 1] = chosen.choice([[], [chosen.choice(WORDS)], [w[at], chosen.choice(WORDS)]])
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    chosen = random.Random(11)
    out = [None, "", "  ", "one", "one", "One", "one two", "one two", "a b c", "a b c d", "A\tb\nc", "é b c", " ", "x " * 3000]
    seeds = [" ".join(chosen.choice(WORDS) for _ in range(n)) for n in (3, 7, 20, 45, 46, 90, 150, 400, 900) for _ in range(4)]
    for s in seeds:
        out += [s, s] + [varied(chosen, s, max(1, len(s.split(" ")) * e // 200)) for e in (1, 2, 4, 7, 9, 12)]
    return dict(enumerate(out))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (3, 60), (1, 100)])
def test_jaccard_join(spark, texts, k, num):
    rows = [(i, t, "x", 1, 2) for i, t in texts.items()]
    table = spark.createDataFrame(rows + [(None, "one", "x", 1, 2), (4, "one", "x", 1, 2)], "doc_id long, text string, key string, n int, cluster int").repartition(3)
    want, sizes = brute.jaccard_components(texts, k, num, 100)
    got = jaccard.link(table, k, num, 100).collect()
    assert len(got) == len(rows) + 2
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, sizes[i], want[i]) for i in texts} | {(None, 1, None)}
    assert jaccard.link(table.limit(0)).collect() == []


def test_jaccard_join_of_a_large_group(spark, monkeypatch):
    """Many variants of one text, in tiles far smaller than the group."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    chosen = random.Random(12)
    seed = " ".join(chosen.choice(WORDS) for _ in range(120))
    texts = dict(enumerate([varied(chosen, seed, chosen.randrange(6)) for _ in range(150)] + [" ".join(chosen.choice(WORDS) for _ in range(60)) for _ in range(20)]))
    want, _ = brute.jaccard_components(texts, 5, 80, 100)
    assert {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()} == want


def test_jaccard_join_of_clusters_that_fall_apart(spark, monkeypatch):
    """Clusters of several tiles of which the hubs connect a part, or nothing, or two groups."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "HUBS", 2)
    chosen = random.Random(23)
    seed = [chosen.choice(WORDS) for _ in range(200)]
    texts, at = {}, 0
    for group in range(6):
        own = list(seed)
        for k in range(12 * group):
            own[(17 * k + 5 * group) % 200] = f"g{group}x{k}"
        for _ in range(25):
            texts[at] = varied(chosen, " ".join(own), chosen.randrange(5))
            at += 1
    monkeypatch.setattr(jaccard, "may_link", lambda s, sizes, x, y, num, den: np.ones((len(sizes[x]), len(sizes[y])), bool))  # so that all are candidates
    want, _ = brute.jaccard_components(texts, 5, 80, 100)
    assert 3 <= len(set(want.values())) < 150
    members = [(1, i, len(brute.shingles(t, 5)), t) for i, t in texts.items()]
    found = jaccard.connected(spark.createDataFrame(members, "cluster long, id long, n int, text string"), 5, 80, 100).collect()
    links = {(r.a, r.b) for r in found}
    assert brute.components(list(texts), lambda a, b: (a, b) in links or (b, a) in links) == want


def test_rows_that_share_an_id_but_not_a_text(spark):
    a, b = " ".join(WORDS[:40]), " ".join(WORDS[100:140])
    rows = [(5, a), (5, b), (3, a), (9, b), (5, b), (5, None), (5, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(table).collect())
    assert got == sorted([(5, 36, 3), (5, 36, 5), (3, 36, 3), (9, 36, 5), (5, 36, 5), (5, 0, 5), (5, 0, 5)])


def test_jaccard_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want, sizes = brute.jaccard_components(texts, 3, 90, 100)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in queries.op5_jaccard_join(spark, DATA).collect()} == {(i, sizes[i], want[i]) for i in texts}


def near_table(rows, least):
    """(n_links, component) of each (id, label, vector) by all pairs."""
    good = {}
    for i, label, v in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float64)
            good[i] = label, u / math.sqrt(float(u @ u))
    near = lambda a, b: a in good and b in good and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and float(good[a][1] @ good[b][1]) >= least
    ids = [r[0] for r in rows]
    return {i: sum(near(i, j) for j in ids if j != i) for i in ids}, brute.components(ids, near)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 8)
    chosen = np.random.default_rng(13)
    rows, at = [], 0
    for _ in range(25):
        centre = chosen.standard_normal(64)
        for _ in range(chosen.integers(1, 14)):
            v = centre + chosen.standard_normal(64) * chosen.choice([0.0, 0.02, 0.05, 0.08])
            rows.append((at, int(chosen.integers(2)), [float(np.float32(x)) for x in v * chosen.choice([1.0, 3.0])]))
            at += 1
    rows += [(at, 1, None), (at + 1, 1, [0.0] * 64), (at + 2, 1, [math.nan] * 64), (at + 3, 1, [None] * 64), (at + 4, None, rows[0][2]), (at + 5, 1, []), (at + 6, 1, [1.0]), (at + 7, 1, [2.0]), (at + 8, 1, [math.inf] * 64)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, id string, copies int").repartition(3)
    links, components = near_table(rows, 0.98)
    got = embeddings.near_duplicates(table).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], components[i], components[i] == i) for i, _, _ in rows}
    assert embeddings.near_duplicates(table.limit(0)).collect() == []
    rows = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert [(r.n_links, r.kept) for r in rows] == [(0, True)] * 2
    again = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (1, [0.0, 1.0], 1), (0, [1.0, 0.001], 1), (2, [1.0], 2), (2, [3.0], 2)]  # ids that repeat with other labels and vectors
    rows = embeddings.near_duplicates(spark.createDataFrame(again, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows) == [(0, 1, 0), (1, 0, 1), (1, 0, 1), (1, 1, 0), (2, 1, 2), (2, 1, 2)]


def test_hub_of_near_vectors(spark):
    """A cluster far beyond a tile, with vectors at its rim that link with some of it only."""
    chosen = np.random.default_rng(19)
    centre = chosen.standard_normal(64)
    rows = [(k, 1, (centre + chosen.standard_normal(64) * s).tolist()) for k, s in enumerate(chosen.choice([0.0, 0.02, 0.06, 0.1], 300))]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    before, embeddings.TILE = embeddings.TILE, 16
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table).collect()}
    finally:
        embeddings.TILE = before
    links, components = near_table(rows, 0.98)
    assert got == {i: (links[i], components[i]) for i in links}


def test_near_vector_recall(spark):
    """Pairs barely above the threshold, where a table is least likely to have them in one bucket."""
    chosen, rows = np.random.default_rng(17), []
    for k in range(600):
        u = chosen.standard_normal(64)
        u /= np.linalg.norm(u)
        w = chosen.standard_normal(64)
        w -= (w @ u) * u
        cosine = chosen.uniform(0.9801, 0.983)
        rows += [(2 * k, 1, u.tolist()), (2 * k + 1, 1, (cosine * u + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)).tolist())]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * 1200 <= found <= 1200


def test_near_vector_query(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    links, components = near_table(rows, 0.98)
    assert {r.vec_id: (r.n_links, r.component_id) for r in queries.op8_embedding_near_dedup(spark, DATA).collect()} == {i: (links[i], components[i]) for i in links}


def test_decontamination(spark):
    chosen = random.Random(14)
    items = {k: " ".join(chosen.choice(WORDS) for _ in range(n)) for k, n in enumerate((5, 9, 20, 33, 60, 60))} | {6: "too short", 7: None, 8: "", 9: "la la la la la la la la la la"}
    items[10] = items[3]
    docs = {}
    for k in range(120):
        text = " ".join(chosen.choice(WORDS) for _ in range(chosen.randrange(0, 90)))
        if k % 2:
            part = varied(chosen, items[chosen.choice([0, 1, 2, 3, 4, 5, 9])], chosen.randrange(4))
            text = f"{text} {part.upper() if k % 3 else part}  and so on"
        docs[k] = text
    docs |= {120: None, 121: "", 122: "la " * 400, 123: items[4], 124: items[4][: len(items[4]) // 2]}
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs.items()] + [(None, items[2], 1, "x")], "doc_id long, text string, len int, window string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items.items()], "item_id long, text string, len int")
    want = {(i, j): best for i, t in docs.items() for j, x in items.items() if (best := brute.weighted_windows(t, x, 0.8))}
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.find(d, b).collect()}
    sure = {p for p, best in want.items() if best[0] >= 0.85}
    assert set(got) <= set(want) and sure <= set(got) and len(got) >= 0.97 * len(want)
    for p in got:
        assert math.isclose(got[p][0], want[p][0])
    assert decontaminate.find(d.limit(0), b).collect() == [] and decontaminate.find(d, b.limit(0)).collect() == []


def test_decontamination_of_passages_in_another_order(spark):
    chosen = random.Random(20)
    items = {k: " ".join(chosen.choice(WORDS) for _ in range(n)) for k, n in enumerate((60, 80, 45, 120))}
    text = lambda n: " ".join(chosen.choice(WORDS) for _ in range(n))
    docs = {}
    for k, item in items.items():
        w = item.split(" ")
        for j, cut in enumerate((len(w) // 2, len(w) // 3, 10)):
            docs[3 * k + j] = f"{text(chosen.randrange(50))} {' '.join(w[cut:] + w[:cut])} {text(30)}"
    for k, item in items.items():  # halves swapped inside, blocks of ten interleaved
        w = item.split(" ")
        q = len(w) // 4
        docs[100 + k] = f"{text(7)} {' '.join(w[:q] + w[2 * q : 3 * q] + w[q : 2 * q] + w[3 * q :])}"
        tens = [w[a : a + 15] for a in range(0, len(w), 15)]
        docs[110 + k] = f"{' '.join(x for t in tens[::2] + tens[1::2] for x in t)} {text(9)}"
    want = {(i, j): best for i, t in docs.items() for j, x in items.items() if (best := brute.weighted_windows(t, x, 0.8))}
    assert len(want) >= 12 and any(i >= 100 for i, _ in want)
    d, b = (spark.createDataFrame(list(x.items()), f"{name} long, text string") for x, name in ((docs, "doc_id"), (items, "item_id")))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.find(d, b).collect()}
    assert got == {p: (pytest.approx(best[0]), best[1]) for p, best in want.items()}


def test_simhash_is_the_majority_of_bits(spark):
    from pyspark.sql import functions as F

    chosen = random.Random(24)
    rows = [[chosen.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 64, 501)] + [[-1] * 70_000 + [5]]
    table = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "id int, h array<long>")
    for r in table.select("id", decontaminate.simhash(F.col("h")).alias("s")).collect():
        h = rows[r.id]
        want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
        assert r.s % (1 << 64) == want


def test_blocks_meet_within_the_radius(spark):
    from pyspark.sql import functions as F

    chosen = random.Random(25)
    pairs = []
    for _ in range(300):
        a = chosen.getrandbits(64)
        b = a
        for k in chosen.sample(range(64), 19):
            b ^= 1 << k
        pairs.append((a - (1 << 63), b - (1 << 63)))
    table = spark.createDataFrame(pairs, "a long, b long")
    near = table.select(F.arrays_overlap(decontaminate.blocks(F.col("a")), decontaminate.blocks(F.col("b"), 19 // decontaminate.BLOCKS)).alias("met"))
    assert near.where("met").count() == 300


def test_language(spark):
    texts = [(r.doc_id, r.lang) for r in spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").collect()]
    rows = queries.op9_language_id(spark, DATA.replace("0.001", "0.01")).collect()
    lang = dict(texts)
    assert len(rows) == len(texts)
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)


def test_language_of_awkward_texts(spark):
    rows = [(1, "the quick brown fox", "en"), (2, "der schnelle braune Fuchs", "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "de"), (6, "der braune", None), (6, "der braune", None), (None, "the fox " * 20000, None)]
    table = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, _lang string")
    got = language.predict(table, language.train(table))
    assert set(got.columns) == {*table.columns, "lang_pred"}
    found = [(r.doc_id, r.lang_pred, r.score) for r in got.collect()]
    assert [(i, x) for i, x, _ in found] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "de"), (None, "en")]
    assert all(s == 0 for _, x, s in found if x == "und")
    assert language.predict(table.limit(0), language.train(table)).collect() == []
    assert {r.lang_pred for r in language.predict(table, language.train(table.limit(0))).collect()} == {"und"}


def test_letters_are_letters_alone():
    assert [language.has_letter(t) for t in ("½ ² 3 _", "1a", "漢", "", None, "ª")] == [False, True, True, False, False, True]


def test_too_many_languages_are_an_error(spark):
    many = spark.range(language.LABELS + 1).selectExpr("id as doc_id", "'some text' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError, match="languages"):
        language.train(many)
    assert len(language.train(many.where("doc_id < 3")).languages) == 3


def held(c):
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "SENT", 40)  # so that most words are looked up by a join
    chosen = random.Random(15)
    docs = {k: " ".join(chosen.choice(WORDS[: 1 + chosen.randrange(300)]) for _ in range(chosen.randrange(60))) for k in range(150)} | {150: None, 151: "", 152: "Ünseen W1  ", 153: "w1 " * 5000}
    training = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    want = brute.base_scores(docs, training)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()] + [(None, "w1", "x", 1)], "doc_id long, text string, token string, n int").repartition(2)
    got = {r.doc_id: r for r in lm.score(table, held("doc_id")).collect()}
    assert len(got) == len(docs) + 1 and got[None].held_out
    for i in docs:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[i][:3] and r.held_out == (not training(i))
        assert math.isclose(r.base_score, want[i][3], rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert lm.score(table.limit(0), held("doc_id")).collect() == []
    assert all(math.isfinite(r.score) for r in lm.score(table.where("doc_id is null"), held("doc_id")).collect())


def test_model_normalises_and_beats_the_base(spark):
    pairs = np.random.default_rng(16).poisson(0.5, (40, 40)).astype(float)
    assert np.allclose(np.exp(lm.train(pairs, steps=50)).sum(1), 1)
    rows = [r for r in queries.op2_lm_scoring(spark, DATA.replace("0.001", "0.01")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_rare_tokens_learn_vectors_of_their_own(spark, monkeypatch):
    """Words of one bucket, rarer than all that have an output of their own: each comes before one common word and after another."""
    from pyspark.sql import functions as F

    chosen = random.Random(18)
    common, n = [f"c{k}" for k in range(lm.OWN + 30)], 8
    triples = [(f"c{2 * k}", f"rare{k}xx", f"c{2 * k + 1}") for k in range(n)]
    texts = [" ".join(chosen.choices(common, k=300)) for _ in range(600)]
    texts += [" ".join(w for _ in range(20) for w in (*chosen.choices(common, k=2), *chosen.choice(triples))) for _ in range(40)]
    texts += [f"{triples[i][0]} {triples[j][1]} {triples[k][2]}" for i in range(n) for j in range(n) for k in range(n)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score(table, F.col("doc_id") >= 640).collect()}
    score = np.array([got[k] for k in range(640, len(texts))]).reshape(n, n, n)
    mine = np.array([score[j, j, j] for j in range(n)])
    assert all(score[j, j].argmax() == j and score[:, j, j].argmax() == j for j in range(n)), (score[0, 0], score[:, 0, 0])
    assert all(mine[j] > max(score[i, j, k] for i in range(n) for k in range(n) if i != j and k != j) + 1 for j in range(n))
    monkeypatch.setattr(lm, "SENT", lm.OWN + 31)  # so that they are looked up by a join
    again = {r.doc_id: r.score for r in lm.score(table, F.col("doc_id") >= 640).collect()}
    assert all(math.isclose(again[i], got[i], rel_tol=1e-4) for i in got)


def test_tied_tokens_have_outputs_of_their_own(spark, monkeypatch):
    """The most frequent tokens are sent whatever their number: ties go by bytes."""
    monkeypatch.setattr(lm, "SENT", 40)
    counts = spark.range(3000).selectExpr("cast(concat('t', id) as binary) AS token", "cast(7 AS long) AS n")
    vocab = lm.vocabulary(counts)
    assert vocab.words == sorted(b"t%d" % k for k in range(3000))[: lm.OWN] and (vocab.total, vocab.distinct) == (21_000, 3000)
