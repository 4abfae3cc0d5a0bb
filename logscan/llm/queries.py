"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscan.llm import bpe, centroids, conversation_repair, decontaminate, language_id, line_dedup, minhash, nearest, packing, personal_data, sharding, substring_dedup, toxicity
from logscan.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), numbered AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows
), gone AS (
  SELECT DISTINCT doc_id, s + j AS p FROM (SELECT doc_id, s, unnest(range(0, 20)) AS j FROM numbered WHERE n > 1)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), marked AS (
  SELECT w.doc_id, w.word, w.p, g.p IS NOT NULL AS gone FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


#: Bytes of text that a shard may hold.
SHARD_BYTES = 1 << 20


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return out.select("doc_id", "shard", "depth", "shard_bytes", "oversized")


OP2_SQL = f"""
WITH hashed AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), levels AS (
  SELECT doc_id, h, size, d, h >> (60 - d) AS prefix FROM hashed, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS d)
), buckets AS (
  SELECT d, prefix, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM levels GROUP BY d, prefix
), fitting AS (
  SELECT l.doc_id, l.h, l.d, b.bytes, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.d) AS nth
  FROM levels l JOIN buckets b ON l.d = b.d AND l.prefix = b.prefix
  WHERE b.bytes <= {SHARD_BYTES} OR b.n = 1 OR b.d = 60
)
SELECT doc_id, CASE WHEN d = 0 THEN '' ELSE lpad(bin(h >> (60 - d)), d, '0') END AS shard, d AS depth,
       bytes AS shard_bytes, bytes > {SHARD_BYTES} AS oversized
FROM fitting WHERE nth = 1
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), ds AS (
  SELECT doc_id, i, len(w) - 4 AS m, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM t WHERE len(w) >= 5)
), bs AS (
  SELECT item_id, len(w) - 4 AS n, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS h FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS i FROM b WHERE len(w) >= 5)
), starts AS (
  SELECT DISTINCT ds.doc_id, bs.item_id, bs.n, ds.m, greatest(0, least(ds.i - j, ds.m - bs.n)) AS s
  FROM ds JOIN bs ON ds.h = bs.h, unnest(range(0, bs.n)) r(j)
), counts AS (
  SELECT s.doc_id, s.item_id, s.n, s.m, s.s, ds.h, count(*) AS c FROM starts s JOIN ds ON ds.doc_id = s.doc_id AND ds.i >= s.s AND ds.i < s.s + s.n GROUP BY ALL
), items AS (
  SELECT item_id, h, count(*) AS ic FROM bs GROUP BY ALL
), sims AS (
  SELECT c.doc_id, c.item_id, c.s, sum(least(c.c, i.ic)) AS both_, c.n + least(c.n, c.m) AS total FROM counts c JOIN items i ON i.item_id = c.item_id AND i.h = c.h GROUP BY ALL
), best AS (
  SELECT doc_id, item_id, s, CAST(both_ AS DOUBLE) / CAST(total - both_ AS DOUBLE) AS similarity FROM sims
)
SELECT doc_id, item_id, max(similarity) AS similarity FROM best WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return out.select("query_id", "rank", "vec_id", "score")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, spans = personal_data.find(table(spark, sf_dir, "documents")), F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(personal_data.KINDS)]
    return out.select("doc_id", *counts, F.sha2(personal_data.listed(base), 256).alias("base_sha256"), personal_data.listed(spans).alias("spans"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id, r.root = d.doc_id AS kept
FROM d JOIN roots r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(language_id.remainder(4) != 2))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (language_id.remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), language_id.remainder(5) == 0
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    out = toxicity.score(docs, grammar)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    summary, turns = conversation_repair.repair(conversation_repair.damage(conversations))
    same = lambda other: F.col("conv_id").eqNullSafe(F.col(other))
    every = conversations.select("conv_id").distinct()
    told = every.join(summary.withColumnRenamed("conv_id", "_told"), same("_told"), "left").join(conversation_repair.digests(turns).withColumnRenamed("conv_id", "_left"), same("_left"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


OP11_SQL = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), bits(b, n, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE n < 8
), crc AS (
  SELECT list(c ORDER BY b) AS t FROM bits WHERE n = 8
), faults AS (
  SELECT h.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                              lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS f
  FROM hashed h, crc
), damaged AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE f WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM faults WHERE f <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         left(role, 1) AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink
  FROM damaged
), told AS (
  SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair
  FROM placed
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id
), grammar(st, role, nxt) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), fills(st, nxt, cost, audit, out) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
         (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
         (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])
), walk(conv_id, i, n, st, cost, audit, out) AS (
  SELECT s.conv_id, CAST(0 AS BIGINT), s.n, f.nxt, CAST(f.cost AS BIGINT), f.audit, f.out FROM sums s JOIN fills f ON f.st = 0
  UNION ALL
  SELECT conv_id, i, n, nxt, best.cost, best.audit, best.out FROM (
    SELECT conv_id, i, n, nxt, min({'cost': cost, 'audit': audit, 'out': out}) AS best FROM (
      SELECT e.conv_id, e.i, e.n, f.nxt, e.cost + f.cost AS cost, e.audit || f.audit AS audit, list_concat(e.out, f.out) AS out FROM (
        SELECT w.conv_id, w.i + 1 AS i, w.n, w.st, w.cost + 4 AS cost, w.audit || 'D' AS audit, w.out FROM walk w WHERE w.i < w.n
        UNION ALL
        SELECT w.conv_id, w.i + 1, w.n, g.nxt, w.cost + CASE t.fault WHEN 'truncated' THEN 3 ELSE 0 END + CASE k.k WHEN 'R' THEN 3 ELSE 0 END, w.audit || k.k,
               list_append(w.out, CASE k.k WHEN 'K' THEN t.role WHEN 'R' THEN CASE g.role WHEN 'u' THEN 'user' ELSE 'assistant' END END || ':' || t.text)
        FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN grammar g ON g.st = w.st, (VALUES ('K'), ('R')) k(k)
        WHERE t.fault NOT IN ('blank', 'duplicate') AND CASE k.k WHEN 'K' THEN t.r = g.role ELSE g.role <> 's' END
      ) e JOIN fills f ON f.st = e.st
    ) GROUP BY conv_id, i, n, nxt
  )
), best AS (
  SELECT conv_id, min({'cost': cost, 'audit': audit, 'out': out}) AS b FROM walk WHERE i = n AND st IN (0, 3) GROUP BY conv_id
)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
       coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, CAST(coalesce(b.b.cost, 0) AS BIGINT) AS cost,
       coalesce(b.b.audit, '') AS audit, sha256(coalesce(array_to_string(b.b.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _lloyd(rounds: int) -> str:
    """SQL of Lloyd's rounds in full: assignments a0, a1, ... and centroids c0, c1, ..."""
    out = []
    for n in range(rounds + 1):
        out.append(f"""a{n} AS (
  SELECT v.n, v.vec_id, v.x, arg_min(c.k, (c.d, c.k)) AS k, min(c.d) AS d
  FROM (SELECT v.n, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{n} c) c JOIN v ON v.n = c.n
  GROUP BY v.n, v.vec_id, v.x
)""")
        if n < rounds:
            out.append(f"""s{n} AS (
  SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY k, i
), c{n + 1} AS (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c
  LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{n} GROUP BY k) m ON m.k = c.k
)""")
    return ", ".join(out)


OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x FROM v ORDER BY k LIMIT 16
), {_lloyd(3)}, ends AS (
  SELECT k, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM c3
)
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, e.centroid_sha256
FROM a3 a JOIN ends e ON e.k = a.k
"""


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end=2)


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_sharding, op3_decontamination, op4_nearest, op5_personal_data, op6_bpe, op7_minhash, op8_line_dedup, op9_language_id, op10_toxicity, op11_conversation_repair, op12_centroid_clustering, op13_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_sharding": OP2_SQL, "op3_decontamination": OP3_SQL, "op4_nearest": OP4_SQL, "op7_minhash": OP7_SQL, "op8_line_dedup": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op12_centroid_clustering": OP12_SQL}
