"""The prefix trie, the Merkle manifest and byte-level BPE, against plain versions and the tiktoken library."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from callweave.llm import byte_bpe, merkle, prefix_trie, queries
from callweave.llm.common import numbered
from tests.conftest import DATA
from tests.llm import brute

TURNS = "conv_id long, turn long, role string, text string, part string, depth int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, rank int"


def conversations(chosen):
    rows = []
    for c in [*range(100, 160), -205, -200, 300, 777]:
        rows += [(c, t, chosen.choice("ua"), chosen.choice(["", "a", "bb", "aa"])) for t in range(chosen.choice([0, 1, 2, 3, 7]))]
    rows += [(400, k, "u", str(k)) for k in range(60)] + [(401, k, "u", str(k)) for k in range(40)] + [(402, k, "u", str(k) if k < 30 else "z") for k in range(50)]
    rows += [(None, 1, "u", "x"), (500, 0, None, None), (501, 0, "", ""), (502, None, "u", "first"), (502, 0, "u", "then"), (503, 1, "u", "twice"), (503, 1, "u", "twice"), (504, 9, "u", "x" * 100_000)]
    return rows + [(c, 0, "u", "same") for c in range(10_001, 10_600)]


def nodes(table):
    return sorted(map(tuple, prefix_trie.trie(table).collect()), key=str)


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = conversations(random.Random(2))
    table = spark.createDataFrame([(*r, "p", 9) for r in rows], TURNS).repartition(3)
    assert nodes(table) == sorted(brute.prefix_trie(rows), key=str)
    assert nodes(table.limit(0)) == []
    assert nodes(table.where("conv_id is null")) == []


def test_prefix_trie_of_one_long_conversation(spark):
    """Its nodes are one run or a few, whatever its length: the rounds do not follow it."""
    rows = [(100, k, "u", f"t{k}") for k in range(3000)] + [(107, k, "u", f"t{k}") for k in range(2000)]
    assert nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == sorted(brute.prefix_trie(rows), key=str)


def test_conversations_that_are_left_without_turns(spark):
    """A conversation whose first turns are replaced by those of an absent one: a member of the root alone."""
    rows = [(c, 0, "u", "x") for c in range(1, 60)]
    got = nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got == sorted(brute.prefix_trie(rows), key=str) and {r[1] for r in got} == {0, 1}
    gone = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 6]
    [root] = nodes(spark.createDataFrame(gone, "conv_id long, turn long, role string, text string"))
    assert root[1:7] == (0, None, len(gone), 0, 1, 0)


def test_prefix_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op11_prefix_trie(spark, DATA).collect()), key=str) == sorted(brute.prefix_trie(rows), key=str)


def test_numbers_across_tasks(spark):
    """Keys that span several tasks, nulls, and equal rows."""
    chosen = random.Random(5)
    rows = [(chosen.choice([None, "a", "b", "b", "b", "b", "c", "é"]), chosen.choice([None, *range(40)])) for _ in range(2000)]
    table = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = [(r.k, r.v, r.rank, r.number, r.last) for r in numbered(table, "k", ["v"]).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0))
    keys = list(dict.fromkeys(r[0] for r in order))
    want, seen = [], {}
    for k, (key, v) in enumerate(order):
        want.append((key, v, keys.index(key), seen.get(key, 0), k + 1 == len(order) or order[k + 1][0] != key))
        seen[key] = seen.get(key, 0) + 1
    assert sorted(got, key=lambda r: r[2:4]) == want
    assert numbered(table.limit(0), "k", ["v"]).collect() == []


def documents(chosen, n):
    rows = [(None, "a\nb", None, None, None), (7, "x", "en", "solo", 1), (7, "x", "en", "src0", 1), (7, "x", "en", "src0", 1), (7, None, "en", "src0", 1), (8, "a\nb", "en", None, 3), (9, "", "en", "é", 3), (10, "\n", "", "", 1)]
    return rows + [(k, "long\n" * chosen.choice([1, 3, 9999]), chosen.choice(["en", None]), chosen.choice(["hot", "hot", f"s{k}"]), chosen.choice([None, k])) for k in range(n)]


@pytest.mark.parametrize("n", [0, 60])
def test_merkle_manifest(spark, n):
    rows = documents(random.Random(6), n)
    table = spark.createDataFrame([(*r, "l", 1) for r in rows], DOCS).repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    got = sorted((tuple(r) for r in merkle.manifest(table, tampered).collect()), key=str)
    assert got == sorted(brute.merkle_manifest(rows), key=str)
    assert all(r.verified for r in merkle.manifest(table).collect())
    assert merkle.manifest(table.limit(0)).collect() == []


def test_a_single_document_is_the_root(spark):
    [r] = merkle.manifest(spark.createDataFrame([(1, "t", "en", "s", 1, "l", 1)], DOCS)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == hashlib.sha256().hexdigest()


def test_merkle_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, DATA).collect()), key=str) == sorted(brute.merkle_manifest(rows), key=str)


AWKWARD = [None, "", " ", "\n\n", "a", "<|endoftext|> x", "Ünïcode  ＡＢ 漢字 😀 İ\tz", "x" * 5000, "ab" * 3000, "1,2;3 don't  stop\r\nnow ", "word " * 6000, "a\x1cb \x85 c᠎ d​  e\x1f", "  lead\n trail \n", "　全角 空白", " " * 3000, "-" * 100 + "=-" * 200]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})


def little(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_byte_bpe_is_the_librarys(spark, library):
    path, pattern, plain = library
    chosen = random.Random(7)
    texts = AWKWARD + ["".join(chosen.choice("ab cdé漢 \n\t.,1'sxX ") for _ in range(chosen.randrange(80))) for _ in range(500)]
    texts += ["".join(chosen.choice("abcdefgh") for _ in range(700))]
    table = spark.createDataFrame([(k, t, "i", "d") for k, t in enumerate(texts)] + [(None, "no id", "", ""), (None, "no id", "", "")], "doc_id long, text string, ids string, decoded string").repartition(3)
    coded = byte_bpe.encode(table, path, pattern, decoded=True).collect()
    assert len(coded) == len(texts) + 2
    for r in coded:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert bytes(r.ids) == little(plain.encode_ordinary(text)) and bytes(r.decoded) == text.encode()
    ids = byte_bpe.encode(table, path, pattern)
    assert {(r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(ids, path, pattern).collect()} == {(r.doc_id, bytes(r.decoded)) for r in coded}
    assert byte_bpe.encode(table.limit(0), path, pattern, decoded=True).collect() == []


def test_queries_that_stop_and_go_on(library, monkeypatch):
    """Few steps a query, small batches and blocks, and a cache that is dropped between texts."""
    path, pattern, plain = library
    monkeypatch.setattr(byte_bpe, "ALL", byte_bpe.ALL.replace(str(byte_bpe.STEPS), "2"))
    for name, value in (("BYTES", 50), ("CACHE", 3), ("BLOCK", 5), ("LONG", 9)):
        monkeypatch.setattr(byte_bpe, name, value)
    coder = byte_bpe.Coder(path, pattern)
    for text in ["internationalisation of supercalifragilistic words", "abab" * 30 + " zzzzzzzzzzzz", "漢字かな交じり文", ""]:
        ids = coder.encode([text, text])
        assert ids == [little(plain.encode_ordinary(text))] * 2 and coder.decode(ids) == [text.encode()] * 2
    with pytest.raises(ValueError):
        coder.decode([little([10**6])])


def test_byte_bpe_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op13_byte_bpe(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        ids = library[2].encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(little(ids)).hexdigest(), brute.sha256(texts[r.doc_id]))
