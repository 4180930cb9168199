"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    chat, katz, knn, language_id, minhash, mixing, packing, phrases, quality, runs, url_filter, vectors, warc,
)
from ledgerlens.llm.common import WORD, word_count
from ledgerlens.plans.registry import Query, near, near_sql, table
from ledgerlens.scratch import scratch_path

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


WORD_SQL = r"'[^\x20\x09-\x0D]+'"
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# needs link(x, y) in both directions; gives root(id, component)
REACH_SQL = """
reach(a, b) AS (SELECT x, y FROM link UNION SELECT r.a, l.y FROM reach r JOIN link l ON r.b = l.x),
root AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)"""


@query("op1_embedding_dedup", f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE len(a.e) = len(b.e)
    AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
link AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair),{REACH_SQL},
degree AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
       vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN degree ON x = vec_id LEFT JOIN root ON id = vec_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


@query("op2_minhash_dedup", f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, {WORD_SQL}) AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, coalesce(len(s), 0) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
pair AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * both_have >= 80 * (a.n + b.n - both_have)),
link AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair),{REACH_SQL}
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id,
       doc_id = coalesce(component, doc_id) AS kept
FROM n LEFT JOIN root ON id = doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=80)


@query("op4_source_mix", f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORD_SQL})), 0) AS size FROM documents),
s AS (SELECT source, sum(size) AS own, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1 AS weight, 3 * own AS cap FROM s),
c AS (
  SELECT *, sum(own) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM w),
l AS (
  SELECT min_by(CAST(total - cap_before AS DOUBLE) / CAST(weights - weight_before AS DOUBLE), weight_before) AS level FROM c
  WHERE CAST(cap AS DOUBLE) >= CAST(total - cap_before AS DOUBLE) / CAST(weights - weight_before AS DOUBLE) * weight),
t AS (SELECT source, own, place, least(level * weight, CAST(cap AS DOUBLE)) AS target FROM w, l),
b AS (
  SELECT row_number() OVER () AS row, d.doc_id, d.size, own, target, [0.5, 0.0, -0.5][place % 3 + 1]::DOUBLE AS a, coalesce(sum(d.size) OVER (
    PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':42'), doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (
  SELECT *, unnest(CASE WHEN size > 0 AND target > 0 THEN list_filter(list_transform([0, 1, 2],
    lambda c: CAST(2 * (c * own + before) + size AS DOUBLE) / (2.0 * target)), lambda y: y <= 1) ELSE [] END) AS y FROM b),
o AS (
  SELECT row, row_number() OVER (ORDER BY 2 * y / (1 + a + sqrt((1 + a) * (1 + a) - 4 * a * y)), doc_id NULLS LAST) - 1 AS n FROM y),
taken AS (SELECT row, count(*) AS copies, min(n) AS first_order, max(n) AS last_order FROM o GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(own AS BIGINT) AS source_size, target,
  CAST(coalesce(copies, 0) * size AS BIGINT) AS taken, first_order, last_order
FROM b LEFT JOIN taken USING (row)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    return mixing.training_order(mixed).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken",
        F.array_min("orders").alias("first_order"), F.array_max("orders").alias("last_order"))


MARKED = f"{chat.END}{chat.START}assistant ok"


@query("op5_chat_format", rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{MARKED}' UNION ALL SELECT -1, 1, 'assistant', '{MARKED}'),
n AS (
  SELECT *, row_number() OVER o - 1 AS i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]{{1,4}}')) + 4 AS tokens,
    len('<|im_start|>' || role || chr(10) || replace(replace(text, '^', '^^'), '<|', '<^|') || '<|im_end|>' || chr(10)) AS chars
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (
  SELECT *, coalesce(sum(tokens) OVER o, 0) AS p, coalesce(sum(chars) OVER o, 0) AS cp
  FROM n WINDOW o AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ends AS (
  SELECT conv_id, i AS i, p, cp FROM p
  UNION ALL SELECT conv_id, max(i) + 1, sum(tokens), sum(chars) FROM p GROUP BY conv_id),
c AS (
  SELECT conv_id, max(i) + 1 AS m, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS s,
    max(CASE WHEN i = 0 AND role = 'system' THEN tokens ELSE 0 END) AS sys,
    max(CASE WHEN i = 0 AND role = 'system' THEN chars ELSE 0 END) AS sys_chars FROM p GROUP BY conv_id),
w(conv_id, ctx, stop) AS (
  SELECT c.conv_id, c.s, (SELECT coalesce(max(e.i), c.s) FROM ends e, ends f WHERE e.conv_id = c.conv_id AND f.conv_id = c.conv_id
    AND f.i = c.s AND e.i >= c.s AND (c.sys + e.p - f.p <= 512 OR e.i <= c.s + 1)) FROM c
  UNION ALL
  SELECT x.conv_id, x.ctx, (SELECT max(e.i) FROM ends e, ends f WHERE e.conv_id = x.conv_id AND f.conv_id = x.conv_id
    AND f.i = x.ctx AND e.i > x.stop AND (x.sys + e.p - f.p <= 512 OR e.i = x.stop + 1))
  FROM (SELECT w.conv_id, w.stop, c.sys, (SELECT c.s + count(*) FROM ends g, ends h, ends k
      WHERE g.conv_id = w.conv_id AND h.conv_id = w.conv_id AND k.conv_id = w.conv_id AND g.i >= c.s AND g.i < w.stop
        AND h.i = w.stop AND k.i = w.stop + 1 AND h.p - g.p > least(128, 512 - c.sys - (k.p - h.p))) AS ctx
    FROM w JOIN c USING (conv_id) WHERE w.stop < c.m) x),
size AS (
  SELECT w.conv_id, CAST(sum(c.sys_chars + e.cp - f.cp) AS BIGINT) AS formatted_chars
  FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN ends e ON e.conv_id = w.conv_id AND e.i = w.stop
  JOIN ends f ON f.conv_id = w.conv_id AND f.i = w.ctx GROUP BY w.conv_id)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars
FROM n JOIN size USING (conv_id) GROUP BY conv_id""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    read = chat.read_windows(chat.format_windows(turns.union(marked)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))


# fixed values: the rules of the query
RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]


@query("op7_url_filter", rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES {", ".join(str(r) for r in RULES)}),
best AS (
  SELECT DISTINCT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (host, path)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(str(r) for r in RULES)
    listed = spark.sql(f"SELECT * FROM VALUES {values} AS r(verdict, host, path)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


@query("op10_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest_by_product(table(spark, sf_dir, "embeddings"), k=5, scale=256, query=F.col("vec_id") % 50 == 0)


def remainder(n: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    return quality.classify(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_warc", """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT h, n, max(page_id) AS top FROM p GROUP BY h, n)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN g USING (h, n)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read_archives(spark, path).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"))


def periodic_words(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by its hash) repeats some of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    n = F.size("words")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    chosen = (F.pmod(h, F.lit(10)) == 0) & (word_count("text") > 0)
    moved = docs.where(chosen).select("doc_id", F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("words"))
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
    return docs.where(~F.coalesce(chosen, F.lit(False))).select("doc_id", "text").union(
        moved.select("doc_id", F.array_join(places, " ").alias("text")))


# CRC-32 of the decimal doc_id, bit by bit
CRC_SQL = """xor(4294967295::UBIGINT, list_reduce(
  list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::UBIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), list_transform(range(0, 8), lambda i: 0::UBIGINT)),
    lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))))"""


@query("op11_periodic_runs", f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, CAST({CRC_SQL} AS BIGINT) AS h, coalesce(regexp_extract_all(text, {WORD_SQL}), []) AS w FROM documents),
e AS (SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS chosen, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM d),
m AS (
  SELECT row, doc_id, n, CASE WHEN chosen THEN list_transform(range(0, n), lambda i:
    w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM e),
p AS (SELECT row, n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM m),
same AS (SELECT x.row, y.i - x.i AS q, x.i FROM p x JOIN p y ON x.row = y.row AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT row, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS part FROM same)
  GROUP BY row, q, part HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (SELECT row, s, len, min(q) AS q FROM stretch GROUP BY row, s, len),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY row ORDER BY len / q DESC, s, q) = 1),
told AS (SELECT row, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS text FROM p ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST(1000 * len // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM m LEFT JOIN told USING (row) LEFT JOIN best USING (row) LEFT JOIN kept USING (row)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(periodic_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.reduce(F.col("runs"), F.get("runs", F.lit(0)), lambda x, y: F.when(
        y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def line_sql(counts: str, count: str) -> str:
    """The slope of the logarithm of counts of counts, each spread over the gap between its neighbours."""
    return f"""(SELECT least({katz.MAX_SLOPE}, coalesce(regr_slope(ln(2.0 * n / (high - low)), ln(r)), {katz.SLOPE})) AS b FROM (
  SELECT r, n, coalesce(lag(r) OVER (ORDER BY r), 0) AS low, coalesce(lead(r) OVER (ORDER BY r), 2 * r - lag(r) OVER (ORDER BY r)) AS high
  FROM (SELECT {count} AS r, count(*) AS n FROM {counts} WHERE {count} <= {katz.FITTED} GROUP BY 1)))"""


@query("op12_katz_score", f"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce({CRC_SQL} % 10 = 0, FALSE) AS held_out,
    list_append(regexp_extract_all(coalesce({LOWER_SQL}, ''), {WORD_SQL}), '') AS w FROM documents),
k AS (SELECT row, doc_id, held_out, unnest(w) AS w, unnest(list_prepend('', w[1:-2])) AS v FROM t),
c AS (SELECT w, count(*) AS c FROM k WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c2 FROM k WHERE NOT held_out GROUP BY v, w),
n AS (SELECT sum(c) AS n, count(*) AS types FROM c),
l1 AS {line_sql('c', 'c')}, l2 AS {line_sql('c2', 'c2')},
one AS (SELECT w, c, c * pow(1 + 1.0 / c, b + 1) / n AS p FROM c, l1, n),
unknown AS (SELECT sum(c - c * pow(1 + 1.0 / c, b + 1)) / any_value(n) AS p0 FROM c, l1, n),
h AS (
  SELECT v, sum(c2) AS total, (1 - sum(c2 * pow(1 + 1.0 / c2, b + 1)) / sum(c2)) / (1 - sum(p)) AS weight
  FROM c2 JOIN one USING (w), l2 GROUP BY v),
s AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known,
    sum(log10((coalesce(c, 0) + 0.1) / (n.n + 0.1 * (types + 1)))) AS base,
    sum(log10(CASE WHEN c2 IS NULL THEN coalesce(weight, 1.0) * coalesce(p, p0) ELSE c2 * pow(1 + 1.0 / c2, b + 1) / total END)) AS score
  FROM k LEFT JOIN one USING (w) LEFT JOIN c2 USING (v, w) LEFT JOIN h USING (v), n, l2, unknown GROUP BY row)
SELECT doc_id, held_out, n_tokens, n_known, CAST((SELECT n FROM n) AS BIGINT) AS train_tokens, {near_sql('base')} AS base_score, {near_sql('score')} AS score
FROM s""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.coalesce(remainder(10) != 0, F.lit(True))
    scored, _ = katz.score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), train)
    return scored.withColumns({c: near(c) for c in ("base_score", "score")})


@query("op13_collocations", f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS k) t, unnest(range(1, len(w) - k + 2)) AS u(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
cut AS (
  SELECT c.lang, c.phrase, c.f, n.n, u.j, l.f AS l, r.f AS r,
    (1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN n USING (lang), unnest(range(1, c.k)) AS u(j)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:u.j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[u.j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT c.lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, max(c.f) AS longer
  FROM c, unnest(range(2, c.k)) AS s(m), unnest(range(1, c.k - m + 2)) AS u(i) GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, f DESC, b.phrase) AS rank, b.phrase, f AS a, l, r, n, score
  FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR longer < f)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))
