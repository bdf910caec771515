"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import archive, byte_bpe, decontaminate, embeddings, jaccard, language, lm, merkle, packing, personal, prefix_trie, secrets, stream_file
from callweave.llm.common import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spelled(spans: str, kinds: list[str]) -> Column:
    """Spans (start, kind, end) as kind:start:end, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(False))
    return lm.score(table(spark, sf_dir, "documents"), ~learned)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive.convert(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    shown = found.select("doc_id", "spans", base.alias("base"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"))
    return shown.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spelled("base", secrets.KINDS), 256).alias("base_sha256"), spelled("spans", secrets.KINDS).alias("spans"), "n_random")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_stream_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = stream_file.write(table(spark, sf_dir, "documents"), fresh_path(spark, "token-ids"), tokenizer("word_bpe_49k.json"))
    return stream_file.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    shown = found.withColumn("base", F.filter("spans", lambda s: s["kind"] < 4))
    return shown.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(personal.KINDS)], F.sha2(spelled("base", personal.KINDS), 256).alias("base_sha256"), spelled("spans", personal.KINDS).alias("spans"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~held_out(3, 1)))
    return language.predict(docs.select("doc_id", held_out(3, 1).alias("held_out"), "text"), model).drop("text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def personal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 finds of the base kinds, which SQL can count."""
    return op7_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 finds of the base kinds, which SQL can count."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_warc": op3_warc,
    "op4_secret_scan": op4_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_stream_file": op6_stream_file,
    "op7_personal_data": op7_personal_data,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_byte_bpe": op13_byte_bpe,
    "personal_counts": personal_counts,
    "secret_counts": secret_counts,
}

REACHED = """
  reached AS (SELECT id AS x, id AS y FROM ids UNION SELECT x, e.b FROM reached JOIN ends e ON y = e.a),
  components AS (SELECT x AS id, min(y) AS component_id FROM reached GROUP BY 1)"""

#: CRC-32 of a string of ASCII characters: each is put in, and eight bits are shifted out.
CRC32 = "xor(list_reduce([4294967295] || flatten(list_transform(range(1, length({0}) + 1), lambda i: [ascii(({0})[i]), 0, 0, 0, 0, 0, 0, 0])), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"
FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
FIELDS = " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

#: Tokenizers, models, kernels and sketches have none; they are tested against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html)::BIGINT AS bytes, sha1(html) AS digest FROM p),
     first AS (SELECT digest, max(page_id) AS best FROM d WHERE bytes >= 1000 GROUP BY 1)
SELECT page_id, bytes AS payload_bytes, d.digest AS payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to
FROM d LEFT JOIN first ON d.digest = first.digest AND bytes >= 1000
""",
    "op5_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
  g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
  sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
  met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
  ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), ids AS (SELECT doc_id AS id FROM documents), {REACHED}
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM w LEFT JOIN sizes USING (doc_id) JOIN components ON id = w.doc_id
""",
    "op8_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), ids AS (SELECT vec_id AS id FROM embeddings), {REACHED},
  many AS (SELECT a, count(*) AS n FROM ends GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN components ON id = vec_id LEFT JOIN many ON many.a = vec_id
""",
    "personal_counts": r"""
WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
  list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS c,
  list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS p FROM documents)
SELECT doc_id, len(e)::BIGINT AS n_email, len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::DOUBLE)) <= 255))::BIGINT AS n_ip,
  len(list_filter(c, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN k % 2 = 1 THEN x[k]::INT WHEN x[k]::INT > 4 THEN x[k]::INT * 2 - 9 ELSE x[k]::INT * 2 END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(p, lambda x: x BETWEEN 9 AND 15))::BIGINT AS n_phone FROM m
""",
    "secret_counts": r"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex FROM documents
""",
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS j FROM conversations WHERE conv_id IS NOT NULL),
  ids AS (SELECT c, c - c % 100 AS base, {CRC32.format("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
  r AS (SELECT ids.c, 0 AS own, j, role, text FROM ids JOIN t ON t.c = base AND j <= h UNION ALL SELECT t.c, 1, j, role, text FROM t JOIN ids ON t.c = ids.c WHERE j > h),
  n AS (SELECT c, length(role) || ':' || role || text AS turn, length(text) AS chars, row_number() OVER (PARTITION BY c ORDER BY own, j) AS d FROM r),
  p AS (SELECT c, d, list(turn) OVER (PARTITION BY c ORDER BY d) AS prefix, chars FROM n UNION ALL SELECT c, 0, [], 0 FROM ids),
  nodes AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY d, prefix),
  place AS (SELECT p.c, d, nodes.conv_id FROM p JOIN nodes USING (d, prefix)),
  named AS (SELECT m.conv_id, m.d, m.n_convs, m.chars, q.conv_id AS parent FROM nodes m LEFT JOIN place q ON q.c = m.conv_id AND q.d = m.d - 1),
  kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n FROM named WHERE d > 0 GROUP BY ALL),
  sums AS (SELECT q.conv_id, q.d, sum((m.n_convs - 1) * m.chars) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
           FROM named m LEFT JOIN kids k USING (conv_id, d) JOIN place q ON q.c = m.conv_id AND q.d <= m.d GROUP BY ALL),
  ends AS (SELECT conv_id, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS h FROM place JOIN (SELECT c, max(d) AS d FROM p GROUP BY 1) USING (c, d) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, parent AS parent_conv_id, n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM named m JOIN sums USING (conv_id, d) LEFT JOIN kids k USING (conv_id, d) LEFT JOIN ends USING (conv_id, d)
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE l AS (SELECT doc_id, source, sha256({FIELDS} || {FIELD.format("text")}) AS leaf,
    sha256({FIELDS} || {FIELD.format("CASE WHEN coalesce(" + CRC32.format("doc_id::VARCHAR") + " % 2 = 0, false) THEN replace(text, chr(10), '') ELSE text END")}) AS changed FROM documents),
  placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS line FROM l),
  up AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed UNION ALL
    SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 3, n),
  subs AS (SELECT tree, digest AS subroot FROM up WHERE n = 1),
  top AS (SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subs) AS n, subroot AS digest FROM subs UNION ALL
    SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
  every AS (SELECT false AS upper, * FROM up WHERE n > 1 UNION ALL SELECT true, 0, * FROM top WHERE n > 1),
  runs AS (SELECT upper, tree, level, pos // 3 AS run, list(digest ORDER BY pos) AS d FROM every GROUP BY ALL),
  sides AS (SELECT upper, tree, level, run * 3 + i - 1 AS pos, array_to_string(d[1:i - 1], '') AS a, array_to_string(d[i + 1:], '') AS z FROM (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM runs)),
  inner_fold AS (SELECT line, tree, 0 AS level, pos, n, changed AS folded, '' AS proof FROM placed UNION ALL
    SELECT f.line, f.tree, f.level + 1, f.pos // 3, (n + 2) // 3, sha256(a || folded || z), proof || a || z FROM inner_fold f JOIN sides s ON NOT upper AND s.tree = f.tree AND s.level = f.level AND s.pos = f.pos WHERE n > 1),
  outer_fold AS (SELECT line, 0 AS level, tree AS pos, (SELECT count(*) FROM subs) AS n, folded, proof FROM inner_fold WHERE n = 1 UNION ALL
    SELECT f.line, f.level + 1, f.pos // 3, (n + 2) // 3, sha256(a || folded || z), proof || a || z FROM outer_fold f JOIN sides s ON upper AND s.level = f.level AND s.pos = f.pos WHERE n > 1)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM placed JOIN subs USING (tree) JOIN (SELECT line, folded, proof FROM outer_fold WHERE n = 1) USING (line) CROSS JOIN (SELECT digest FROM top WHERE n = 1)
""",
}
