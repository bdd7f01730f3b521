"""Queries of the training-data operators and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import chat_format, decontaminate, lexical_tree, licenses, merkle_manifest, prefix_hash, signature_join, substring_dedup, surrogates, token_rollup, toxicity, transport_stream, vector_packing
from panelspark.llm.common import read

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_transport_stream")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = transport_stream.store(transport_stream.encode(read(spark, sf_dir, "documents")))
    return transport_stream.features(media)


PROBE = "</s>[INST] ok [/INST]"


@query(
    "op3_chat_format",
    f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    length(replace(text, '\\', '\\\\')) + len(regexp_extract_all(text,
      '<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|(endoftext|im_start|im_head|im_next|im_end)\\|>')) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN before = role THEN 11 ELSE 12 + length(role) + 12 END
        + CASE WHEN after = role THEN 0 ELSE 11 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '{PROBE}' AS text FROM range(2)")
    return chat_format.digest(chat_format.format_chat(turns.unionByName(probe)))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_vector_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(read(spark, sf_dir, "documents"))


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


@query(
    "op8_substring_doubling",
    f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first_id FROM h GROUP BY h),
c AS (SELECT doc_id, unnest(generate_series(i, i + 49)) AS p FROM h JOIN f USING (h) WHERE doc_id > first_id),
g AS (SELECT DISTINCT doc_id, p FROM c),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
  FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), 50).drop("kept_text")


@query(
    "op10_signature_join",
    """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) g ON g.x = d.doc_id
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.join(read(spark, sf_dir, "documents"), 4, 85)


@query("op2_simhash_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op6_surrogates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs).select("doc_id", "text", F.col("_n_entities").alias("n_entities"))


@query("op9_licenses")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licenses.fit_and_scan(docs)


@query("op5_token_rollup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintained(read(spark, sf_dir, "documents"))


#: CRC-32 of a decimal number in SQL: per byte an exclusive-or, then eight shifts (marked -1).
CRC32 = """4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(str_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)"""


def _framed(field: str) -> str:
    return f"coalesce(strlen({field}::VARCHAR)::VARCHAR || ':' || {field}::VARCHAR, '-')"


def _merkle_sql() -> str:
    leaf = lambda n: "sha256(" + " || ".join(_framed(f) for f in ("doc_id", "source", "lang", n, "text")) + ")"
    return f"""
WITH RECURSIVE d AS (SELECT *, {CRC32} AS c FROM documents),
l AS (SELECT doc_id, lang, {leaf('n_chars')} AS leaf,
    CASE WHEN c % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS found FROM d),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (
  SELECT g, 0 AS lvl, i::BIGINT AS i, n::BIGINT AS n, leaf AS h FROM p
  UNION ALL
  SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, lvl, i // 2, n),
s AS (SELECT g, h, lvl AS top FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, g::BIGINT AS i, (SELECT count(*) FROM s)::BIGINT AS n, h FROM s
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
a AS (
  SELECT p.doc_id, p.leaf, p.found, s.h AS subroot, p.g, p.i, 0 AS lvl, s.top, '' AS proof, p.found AS f FROM p JOIN s USING (g)
  UNION ALL
  SELECT a.doc_id, a.leaf, a.found, a.subroot, a.g, a.i // 2, a.lvl + 1, a.top, a.proof || coalesce(t.h, ''),
    sha256(CASE WHEN a.i % 2 = 1 THEN t.h || a.f ELSE a.f || coalesce(t.h, '') END)
  FROM a LEFT JOIN t ON t.g = a.g AND t.lvl = a.lvl AND t.i = xor(a.i, 1) WHERE a.lvl < a.top),
b AS (
  SELECT doc_id, leaf, subroot, g::BIGINT AS i, 0 AS lvl, proof, f FROM a WHERE lvl = top
  UNION ALL
  SELECT b.doc_id, b.leaf, b.subroot, b.i // 2, b.lvl + 1, b.proof || coalesce(u.h, ''),
    sha256(CASE WHEN b.i % 2 = 1 THEN u.h || b.f ELSE b.f || coalesce(u.h, '') END)
  FROM b LEFT JOIN u ON u.lvl = b.lvl AND u.i = xor(b.i, 1) WHERE b.lvl < (SELECT max(lvl) FROM u))
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root,
  f = (SELECT h FROM u WHERE n = 1) AS verified
FROM b WHERE lvl = (SELECT max(lvl) FROM u)
"""


@query("op11_merkle_manifest", _merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    changed = F.crc32(docs["doc_id"].cast("string")) % 7 == 0
    n_chars = docs["n_chars"].cast("long")
    rows = merkle_manifest.manifest(docs, {"n_chars": F.when(changed, n_chars + 1).otherwise(n_chars)})
    return merkle_manifest.verified(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_prefix_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.edited_fingerprints(read(spark, sf_dir, "documents"))


TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(
    "op13_document_tree",
    f"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents),
q AS (SELECT item_id, unnest({TERMS}) AS t FROM benchmark),
v AS (SELECT DISTINCT t FROM q),
s AS (SELECT count(*)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 75 + (25 * len(w)::BIGINT * N) // L AS m FROM d, s WHERE len(w) > 0),
f AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) JOIN v USING (t) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t, N),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN f USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_tree.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
