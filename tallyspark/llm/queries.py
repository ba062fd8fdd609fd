"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language, lexical, neardup, packing, personal, secrets, segment, topk, toxicity, trie, urls, vectors
from .common import fold_of, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(all_.where("id % 50 = 0"), all_, k=5)


def op2_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.encode_samples(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), k=2, keep_ids=False)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 4096, 1, keep_ids=False)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    same = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), same.alias("text")
    )
    done = chat.format_chats(rows.unionByName(extra))
    turns = chat.read_back(F.col("formatted"))
    done = done.withColumn("t", turns).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    digest = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "blocked_score")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 5) == 0
    dicts = language.learn(docs, ~F.coalesce(held, F.lit(False)))
    out = language.identify(docs.select("doc_id", "text"), dicts)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_margin", "lang_rejected")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 4) == 2
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k.name) for k in personal.KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return trie.prefix_trie(trie.branched(table(spark, sf_dir, "conversations"), c - c % 5, F.crc32(c.cast("string")) % 9, 8))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_top_k": op1_top_k,
        "op2_segment": op2_segment,
        "op3_pack": op3_pack,
        "op4_chat": op4_chat,
        "op5_secrets": op5_secrets,
        "op6_urls": op6_urls,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_language": op8_language,
        "op9_near_vectors": op9_near_vectors,
        "op10_toxicity": op10_toxicity,
        "op11_personal": op11_personal,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_lexical": op13_lexical,
        "pipeline": pipeline,
    }


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, w FROM v WHERE vec_id % 50 = 0) q, v c WHERE q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""

OP4_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '(<|\\[)(\\\\*)(/?s>|/?INST\\]|/?ROLE\\]|TURN\\])', '\\1\\\\\\2\\3', 'g') AS te,
    regexp_replace(role, '(<|\\[)(\\\\*)(/?s>|/?INST\\]|/?ROLE\\]|TURN\\])', '\\1\\\\\\2\\3', 'g') AS re,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS fresh
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(te) + CASE WHEN fresh THEN length('<s>[ROLE][/ROLE]</s>') + length(re)
    + CASE WHEN role = 'assistant' THEN 0 ELSE length('[INST][/INST]') END ELSE length('[TURN]') END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _personal_sql() -> str:
    """Every kind's pattern, test and score as DuckDB has them."""
    proposed = "\nUNION ALL ".join(
        f"SELECT rn, doc_id, {i} AS o, '{k.name}' AS kind, {k.score} AS score, '{k.near}' AS near, '{k.far}' AS far, regexp_extract_all(text, '{k.plain}') AS hits, string_split_regex(text, '{k.plain}') AS gaps FROM d"
        for i, k in enumerate(personal.KINDS)
    )
    base = ", ".join(f"'{k.name}'" for k in personal.KINDS if k.base)
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k.name}'), 0) AS n_{k.name}" for k in personal.KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({proposed}),
u AS (
  SELECT *, hits[i] AS v, gaps[i] AS before, gaps[i + 1] AS after,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM p)),
t AS (
  SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits, replace(substring(v, 5) || substring(v, 1, 4), ' ', '') AS turned, right(before, 1) || ' ' || left(after, 1) AS edge,
    lower(right(before, {personal.BEFORE}) || ' ' || left(after, {personal.AFTER})) AS around
  FROM u),
c AS (
  SELECT *, CASE kind
    WHEN 'ip' THEN list_min(list_transform(string_split(v, '.'), lambda x: CAST(length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(x AS HUGEINT), 0) <= 255 AS INT))) = 1
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j:
      CASE WHEN (length(digits) - j) % 2 = 0 THEN CAST(digits[j] AS INT) ELSE (2 * CAST(digits[j] AS INT)) // 10 + (2 * CAST(digits[j] AS INT)) % 10 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN NOT regexp_matches(edge, '[A-Za-z0-9]') AND list_reduce(list_concat([0::HUGEINT], list_transform(range(1, length(turned) + 1), lambda j:
      CAST(CASE WHEN ascii(turned[j]) < 58 THEN ascii(turned[j]) - 48 ELSE ascii(turned[j]) - 55 END AS HUGEINT))), lambda a, x: (CASE WHEN x < 10 THEN a * 10 ELSE a * 100 END + x) % 97) = 1
    WHEN 'ssn' THEN NOT regexp_matches(edge, '[0-9-]') AND NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$')
    WHEN 'local' THEN NOT regexp_matches(edge, '[0-9+-]') AND NOT regexp_matches(right(before, {personal.BEFORE}), '\\+[0-9][\\x20().0-9-]*$')
    ELSE true END AS ok,
    score + CASE WHEN near <> '' AND regexp_matches(around, '(^|[^a-z])(' || near || ')') THEN {personal.UP} ELSE 0 END
      - CASE WHEN far <> '' AND regexp_matches(around, '(^|[^a-z])(' || far || ')') THEN {personal.DOWN} ELSE 0 END AS total
  FROM t),
f AS (SELECT *, kind || ':' || s || ':' || (s + length(v)) AS span FROM c WHERE ok AND (kind IN ({base}) OR total >= 0.5))
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY o, s) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY o, s), '') AS spans
FROM d LEFT JOIN f USING (rn) GROUP BY rn, d.doc_id
"""


OP12_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, octet_length(encode(coalesce(text, ''))) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'id': id, 'size': size} ORDER BY turn NULLS FIRST, role, id) AS ts FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, ts, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda j: CAST(ascii(CAST(conv_id AS VARCHAR)[j]) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 9 AS h
  FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h], []), h.ts[h + 1:]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (
  SELECT conv_id, d, len(ts) = d AS ends, sha256(array_to_string(list_transform(ts[1:d], lambda x: x.id), '')) AS node, sha256(array_to_string(list_transform(ts[1:d - 1], lambda x: x.id), '')) AS up, ts[d].size AS size
  FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (
  SELECT node, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(min(size), 0) * (count(*) - 1) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY node, d),
k AS (SELECT up, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
s AS (SELECT DISTINCT a.node AS top, a.d AS top_d, b.node, b.d FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
w AS (
  SELECT s.top, s.top_d, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM s JOIN n ON n.node = s.node AND n.d = s.d LEFT JOIN k ON k.up = s.node AND k.d = s.d GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(w.n_leaves AS BIGINT) AS n_leaves, CAST(w.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN w ON w.top = n.node AND w.top_d = n.d LEFT JOIN k ON k.up = n.node AND k.d = n.d LEFT JOIN n p ON n.d > 0 AND p.node = n.up AND p.d = n.d - 1
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_TERMS} AS ts FROM documents),
l AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
x AS (SELECT rn, t, count(*) AS tf FROM (SELECT rn, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM x, l GROUP BY t, docs),
c AS (SELECT rn, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * docs) // total))) AS c FROM x JOIN w USING (t) JOIN d USING (rn), l),
s AS (SELECT item_id, rn, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (t) GROUP BY ALL HAVING sum(c) > 0),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM s JOIN d USING (rn))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": OP1_SQL, "op4_chat": OP4_SQL, "op11_personal": _personal_sql(), "op12_prefix_trie": OP12_SQL, "op13_lexical": OP13_SQL}
