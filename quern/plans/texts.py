"""Text, chunk, retrieval, hygiene and data-quality queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import chunking as C
from quern.operators import dedupe as D
from quern.operators import quality as Q
from quern.operators import safety as S
from quern.operators import search as X
from quern.plans.registry import query
from quern.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


@query("normalize_text", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), '\x{00A0}', ' ', 'g'), '\r\n?', chr(10), 'g'),
'[ \t\n\x0B\f\r]+\n', chr(10), 'g'), '\n[ \t\n\x0B\f\r]+', chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS digest FROM documents""")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("digest"))


@query("comparable_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def comparable_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.comparable(F.col("text")).cast("binary")).alias("digest"))


@query("token_count", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents")
def token_count(spark, d):
    return docs(spark, d).select("doc_id", T.token_count(F.col("text")).cast("long").alias("n"))


@query("sentence_count", r"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]+|[^.!?]+$'), lambda s: regexp_matches(s, '\S'))) AS n FROM documents")
def sentence_count(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query("paragraph_split", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n{2,}'), lambda s: regexp_matches(s, '\S'))) AS n FROM documents")
def paragraph_split(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("n"))


_TOKENS = r"t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)"


@query("chunk_tokens", "WITH " + _TOKENS + """, s AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 21) + 1, 180)) AS f FROM t WHERE len(w) > 0)
SELECT doc_id, CAST(f AS INT) AS first_token, md5(array_to_string(w[f + 1 : f + 200], ' ')) AS digest, CAST(least(200, len(w) - f) AS INT) AS tokens FROM s""")
def chunk_tokens(spark, d):
    return C.token_chunks(docs(spark, d), ["doc_id"], max_tokens=200, overlap=20).select("doc_id", "first_token", F.md5(F.col("content").cast("binary")).alias("digest"), "tokens")


@query("chunk_stride", "WITH " + _TOKENS + """, s AS (SELECT doc_id, w, unnest(range(0, len(w), 192)) AS f FROM t)
SELECT doc_id, CAST(f AS INT) AS first_token, md5(array_to_string(w[f + 1 : f + 384], ' ')) AS digest, CAST(least(384, len(w) - f) AS INT) AS tokens FROM s""")
def chunk_stride(spark, d):
    return C.stride_chunks(docs(spark, d), ["doc_id"]).select("doc_id", "first_token", F.md5(F.col("content").cast("binary")).alias("digest"), "tokens")


@query("late_windows", "WITH " + _TOKENS + """, c AS (SELECT doc_id, f // 100 AS i, array_to_string(w[f + 1 : f + 100], ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS f FROM t))
SELECT doc_id, CAST(i AS INT) AS window_start, md5(string_agg(x, ' ') OVER w) AS digest, CAST(count(*) OVER w AS INT) AS n FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) QUALIFY i % 2 = 0""")
def late_windows(spark, d):
    chunks = C.token_chunks(docs(spark, d), ["doc_id"], max_tokens=100)
    return C.late_windows(chunks, "doc_id", "chunk_index", "content", 3, 2).select("doc_id", "window_start", F.md5(F.col("content").cast("binary")).alias("digest"), F.size("merged_from").alias("n"))


@query("table_chunks", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
k AS (SELECT *, (trim(line) LIKE '|%') OR (len(regexp_extract_all(trim(line), ',')) >= 2 AND NOT regexp_matches(trim(line), '[.;]$')) AS t FROM l),
r AS (SELECT *, sum(x) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN t IS NOT DISTINCT FROM lag(t) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS x FROM k))
SELECT doc_id, CASE WHEN t THEN 'table' ELSE 'text' END AS kind, CAST(min(i) AS INT) AS first_line, CAST(count(*) AS INT) AS n_lines FROM r GROUP BY doc_id, run, t HAVING trim(string_agg(line, chr(10) ORDER BY i)) <> ''""")
def table_chunks(spark, d):
    return C.table_chunks(docs(spark, d), ["doc_id"]).select("doc_id", "kind", "first_line", "n_lines")


@query("format_detect", r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 'text' WHEN (t LIKE '{%' OR t LIKE '[%') AND t LIKE '%}' AND json_valid(t) THEN 'json'
WHEN regexp_matches(t, '(?i)<!doctype html>') OR regexp_matches(t, '(?i)<(html|body|head|div|span|p|h[1-6]|section|article|main|nav|table|ul|ol|li)[^>]*>') THEN 'html'
WHEN regexp_matches(t, '\\(section|subsection|subsubsection|begin\{document\})') THEN 'latex' WHEN contains(t, '```') THEN 'code'
WHEN regexp_matches(t, '\n\|.+\|\n') AND regexp_matches(t, '\|\s*-{2,}\s*\|') THEN 'table'
WHEN regexp_matches(t, '(?m)^#{1,6}\s+') OR regexp_matches(t, '(?m)^(\*|-|\+|\d+\.)\s+') OR regexp_matches(t, '(?m)^>\s') OR regexp_matches(t, '\[.+?\]\(.+?\)') THEN 'markdown' ELSE 'text' END AS format FROM t""")
def format_detect(spark, d):
    return docs(spark, d).select("doc_id", T.detect_format(F.col("text")).alias("format"))


@query("html_to_text", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|section|article|header|footer|main|nav|ul|ol|li|table|tr|td|th|h1|h2|h3|h4|h5|h6|br)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS t FROM b)
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\n\x0B\f\r]+\n', chr(10), 'g'), '\n[ \t\n\x0B\f\r]+', chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS digest FROM c""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.html_to_text(F.col("html")).cast("binary")).alias("digest"))


@query("extract_title", "SELECT doc_id, trim(string_split(text, chr(10))[1]) AS title, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: s <> '')[1:2], '. ') AS summary FROM documents")
def extract_title(spark, d):
    return docs(spark, d).select("doc_id", T.title(F.col("text")).alias("title"), T.summary(F.col("text")).alias("summary"))


@query("keywords", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\b[a-z]{3,}\b')) AS w, generate_subscripts(regexp_extract_all(lower(text), '\b[a-z]{3,}\b'), 1) AS i FROM documents),
c AS (SELECT doc_id, w, count(*) AS n, min(i) AS first FROM w GROUP BY 1, 2)
SELECT doc_id, w AS keyword, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS place FROM c QUALIFY place <= 5""")
def keywords(spark, d):
    """Documents are independent: words are counted inside the row, in order of first use, and nothing is shuffled."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"((?<![A-Za-z0-9_])[a-z]{3,}(?![A-Za-z0-9_]))"), F.lit(1))
    return X.top_words(docs(spark, d), ["doc_id"], found, 5).withColumnRenamed("word", "keyword")


@query("questions", r"""
WITH q AS (SELECT doc_id, unnest(string_split(replace(text, '.', '?'), '?')[1 : -2]) || '?' AS q FROM documents)
SELECT doc_id, count(*) AS n, md5(string_agg(trim(q), chr(10) ORDER BY trim(q))) AS digest FROM q GROUP BY 1""")
def questions(spark, d):
    """The table has no question marks, so full stops are made some; each document's questions in order."""
    q = F.array_sort(T.questions(F.replace("text", F.lit("."), F.lit("?"))))
    return docs(spark, d).filter(F.col("text").contains(".") | F.col("text").contains("?")).select("doc_id", F.size(q).cast("long").alias("n"), F.md5(F.array_join(q, "\n").cast("binary")).alias("digest"))


@query("json_flatten", """
SELECT event_id, 'k: ' || json_extract_string(props, '$.k') || ' type: ' || event_type || ' list[0].user: ' || user_id || ' list[1]: null list[2]: {} nested.flag: ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flat FROM events""")
def json_flatten(spark, d):
    """Nested objects, arrays, nulls and empty values in the place of the one-key objects of the table."""
    e = table(spark, d, "events")
    more = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "type": "'), F.col("event_type"), F.lit('", "list": [{"user": '), F.col("user_id").cast("string"), F.lit('}, null, {}], "nested": {"flag": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}}"))
    return C.folded(e.select("event_id", more.alias("props")), ["event_id"], "json", "props").select("event_id", F.regexp_replace("content", "\\s+", " ").alias("flat"))


@query("sentence_pack", r"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?]+[.!?]+|[^.!?]+$'), lambda s: regexp_matches(s, '\S')) AS l FROM documents),
q AS (SELECT doc_id, l, list_transform(l, lambda s: len(regexp_extract_all(s, '\S+'))) AS n, len(l) AS k FROM p WHERE len(l) > 0),
r AS (SELECT doc_id, n, k, 1 AS i, 1 AS first, n[1] AS total, 0 AS chunk, FALSE AS cut FROM q UNION ALL
SELECT doc_id, n, k, i + 1, CASE WHEN total + n[i + 1] > 300 THEN i ELSE first END, CASE WHEN total + n[i + 1] > 300 THEN n[i] + n[i + 1] ELSE total + n[i + 1] END,
CASE WHEN total + n[i + 1] > 300 THEN chunk + 1 ELSE chunk END, total + n[i + 1] > 300 FROM r WHERE i < k)
SELECT doc_id, CAST(chunk AS INT) AS chunk_index, CAST(max(total) AS INT) AS tokens FROM r GROUP BY 1, 2""")
def sentence_pack(spark, d):
    return C.folded(docs(spark, d), ["doc_id"], "sentence", max_tokens=300, overlap=1).select("doc_id", "chunk_index", "tokens")


@query("recursive_chunks")
def recursive_chunks(spark, d):
    return C.folded(docs(spark, d), ["doc_id"], "recursive", max_tokens=300)


@query("slumber_chunks")
def slumber_chunks(spark, d):
    return C.folded(docs(spark, d), ["doc_id"], "slumber", max_tokens=300)


@query("semantic_merge", """
WITH RECURSIVE e AS (SELECT CAST(floor(vec_id / 20) AS BIGINT) AS doc, vec_id, 'chunk ' || vec_id AS c, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY floor(vec_id / 20) ORDER BY vec_id) AS i FROM embeddings),
r AS (SELECT doc, i, 0 AS chunk, c, v, 2 AS tokens FROM e WHERE i = 1 UNION ALL
SELECT doc, i, CASE WHEN j THEN chunk ELSE chunk + 1 END, CASE WHEN j THEN rc || ' ' || c ELSE c END, CASE WHEN j THEN list_transform(list_zip(rv, v), lambda x: (x[1] + x[2]) / 2) ELSE v END, CASE WHEN j THEN tokens + 2 ELSE 2 END
FROM (SELECT e.doc, e.i, e.c, e.v, r.c AS rc, r.v AS rv, r.chunk, r.tokens, r.tokens + 2 <= 450 AND list_cosine_similarity(r.v, e.v) >= 0.5 AS j FROM r JOIN e ON e.doc = r.doc AND e.i = r.i + 1))
SELECT doc, CAST(chunk AS INT) AS chunk_index, max_by(c, i) AS content, CAST(max(tokens) AS INT) AS tokens FROM r GROUP BY 1, 2""")
def semantic_merge(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("doc"), "vec_id", F.concat(F.lit("chunk "), F.col("vec_id")).alias("content"), "embedding")
    return C.semantic_chunks(e, "doc", "vec_id", "content", "embedding", threshold=0.5)


# ------------------------------------------------------------------ retrieval

_Q = "The thing and order of the house"


@query("bm25_topk", r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT DISTINCT unnest(string_split('and house of order the thing', ' ')) AS term), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
p AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, q), f AS (SELECT term, count(*) AS df FROM p WHERE tf > 0 GROUP BY 1),
r AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, doc_id LIMIT 10""")
def bm25_topk(spark, d):
    return X.bm25(docs(spark, d), _Q).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_many", r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY 1, 2)
SELECT item_id, round(score, 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(r.score, 9) DESC, doc_id) AS rank FROM r QUALIFY rank <= 10""")
def bm25_many(spark, d):
    """Benchmark items as queries: the ten best scores of each."""
    return X.bm25_many(docs(spark, d), table(spark, d, "benchmark"), query_id="item_id", query="text").select("item_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query("vector_topk", f"SELECT e.vec_id, round(({_COS} + 1) / 2, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").first()["embedding"]
    return X.vector_topk(e, q, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query("vector_search", f"""
SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 6) AS cos, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE e.vec_id <> q.vec_id QUALIFY rank <= 10""")
def vector_search(spark, d):
    """The ten nearest of every item whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return X.vector_search(e, q, "vec_id", "embedding", "query_id").select("query_id", "vec_id", F.round("cos", 6).alias("cos"), F.col("rank").cast("long").alias("rank"))


@query("vector_stats", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, CAST(len(embedding) AS INT) AS dim FROM embeddings")
def vector_stats(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dim"))


@query("hybrid_topk", r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT DISTINCT unnest(string_split('and house of order the thing', ' ')) AS term), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
p AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, q), f AS (SELECT term, count(*) AS df FROM p WHERE tf > 0 GROUP BY 1),
l AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY 1),
v AS (SELECT e.vec_id AS doc_id, (list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) + 1) / 2 AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
b AS (SELECT doc_id, 0.4 * coalesce(v.score, 0) + 0.6 * coalesce(l.score / (SELECT max(score) FROM l), 0) AS score FROM l FULL JOIN v USING (doc_id))
SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 5""")
def hybrid_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").first()["embedding"]
    vec = e.select(F.col("vec_id").alias("doc_id"), ((V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])) + 1) / 2).alias("score"))
    return X.hybrid(X.bm25(docs(spark, d), _Q, k=None), vec, "doc_id", 0.4).select("doc_id", F.round("score", 6).alias("score"))


@query("retrieval_prf", f"""
WITH n AS (SELECT q.vec_id AS query_id, q.label AS ql, e.label AS el, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE e.vec_id <> q.vec_id QUALIFY rank <= 10),
g AS (SELECT q.vec_id AS query_id, count(*) AS c FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1),
m AS (SELECT query_id, sum((ql = el)::INT) / 10.0 AS p, sum((ql = el)::INT) AS h, min(CASE WHEN ql = el THEN rank END) AS f FROM n GROUP BY 1),
z AS (SELECT query_id, p, h / c AS r, coalesce(1 / f, 0) AS m FROM m JOIN g USING (query_id))
SELECT query_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(m, 6) AS mrr, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END >= 0.3 AS passed FROM z""")
def retrieval_prf(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    found = X.vector_search(e, q.drop("label"), "vec_id", "embedding", "query_id")
    m = X.f1_gate(X.retrieval_metrics_by_label(found, q, e, "query_id", "vec_id", "label"))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mrr")], "passed")


@query("label_prf", """
WITH x AS (SELECT length(text) > 300 AS p, quality = 1 AS a FROM labels JOIN documents USING (doc_id))
SELECT sum((p AND a)::INT)::BIGINT AS tp, sum((p AND NOT a)::INT)::BIGINT AS fp, sum((NOT p AND a)::INT)::BIGINT AS fn,
round(sum((p AND a)::INT) / sum(p::INT), 6) AS "precision", round(sum((p AND a)::INT) / sum(a::INT), 6) AS recall FROM x""")
def label_prf(spark, d):
    x = table(spark, d, "labels").join(docs(spark, d).select("doc_id", F.length("text").alias("n")), "doc_id")
    return X.label_metrics(x, F.col("n") > 300, F.col("quality") == 1).select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_TURNS = r"""
t AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, lag(regexp_extract_all(lower(text), '[a-z0-9]+')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations QUALIFY role = 'assistant' AND b IS NOT NULL),
g AS (SELECT conv_id, turn, n, x, count(*) AS k FROM (SELECT conv_id, turn, n, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i : i + n - 1], ' '))) AS x FROM t, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
h AS (SELECT conv_id, turn, n, x, count(*) AS k FROM (SELECT conv_id, turn, n, unnest(list_transform(range(1, len(b) - n + 2), lambda i: array_to_string(b[i : i + n - 1], ' '))) AS x FROM t, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
c AS (SELECT g.conv_id, g.turn, g.n, sum(least(g.k, h.k)) AS s FROM g JOIN h ON h.conv_id = g.conv_id AND h.turn = g.turn AND h.n = g.n AND h.x = g.x GROUP BY ALL),
z AS (SELECT t.conv_id, t.turn, len(a) AS la, len(b) AS lb, n, coalesce(s, 0) AS s FROM t CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) LEFT JOIN c USING (conv_id, turn, n)),
f AS (SELECT conv_id, turn, max(CASE WHEN n = 1 AND la + lb > 0 THEN 2.0 * s / (la + lb) WHEN n = 1 THEN 0 END) AS r1,
max(CASE WHEN n = 2 AND greatest(la - 1, 0) + greatest(lb - 1, 0) > 0 THEN 2.0 * s / (greatest(la - 1, 0) + greatest(lb - 1, 0)) WHEN n = 2 THEN 0 END) AS r2,
CASE WHEN min(s) > 0 THEN exp(sum(CASE WHEN s > 0 THEN ln(s / greatest(la - n + 1, 1)) END) / 4) * min(least(1.0, exp(1 - lb / greatest(la, 1)))) ELSE 0 END AS bl FROM z GROUP BY 1, 2)
"""


def _turns(spark, d):
    """Each assistant turn with the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).filter("role = 'assistant' AND before IS NOT NULL")


@query("rouge_bleu", "WITH " + _TURNS + "SELECT conv_id, turn, round(r1, 5) AS rouge_1, round(r2, 5) AS rouge_2, round(bl, 5) AS bleu FROM f")
def rouge_bleu(spark, d):
    a, b = F.col("text"), F.col("before")
    return _turns(spark, d).select("conv_id", "turn", F.round(X.rouge_n(a, b, 1), 5).alias("rouge_1"), F.round(X.rouge_n(a, b, 2), 5).alias("rouge_2"), F.round(X.bleu(a, b), 5).alias("bleu"))


@query("rouge_l")
def rouge_l(spark, d):
    """No SQL: a longest common subsequence is a table of numbers for each pair. Tested against brute force."""
    return _turns(spark, d).select("conv_id", "turn", F.round(X.rouge_l(F.col("text"), F.col("before")), 6).alias("rouge_l"))


# ------------------------------------------------------------------ hygiene


@query("exact_dups", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dups(spark, d):
    return D.exact_groups(docs(spark, d), F.md5(F.col("text").cast("binary")), "doc_id").filter("n > 1").select(F.col("key").alias("digest"), "n", "first_id")


_SETS = r"""
c AS (SELECT {id} AS id, trim(regexp_replace(regexp_replace(lower({text}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM {src}),
g AS (SELECT id, CASE WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, CAST(i AS INT), 3))) END AS g FROM c),
k AS (SELECT min(id) AS id, g FROM (SELECT id, list_sort(g) AS g FROM g) GROUP BY g),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS n, len(a.g) AS x, len(b.g) AS y FROM k a JOIN k b ON a.id < b.id AND least(len(a.g), len(b.g)) >= {t} * greatest(len(a.g), len(b.g)))
"""


@query("near_dups", "WITH " + _SETS.format(id="p_partkey", text="p_name", src="part", t=0.4) + "SELECT a, b, round(n / (x + y - n), 6) AS similarity FROM p WHERE n / (x + y - n) >= 0.4")
def near_dups(spark, d):
    return D.similar_pairs(table(spark, d, "part"), "p_partkey", "p_name", 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("near_dup_keep", "WITH o AS (SELECT conv_id * 1000 + turn AS id, text, length(text) AS score FROM conversations), " + _SETS.format(id="id", text="text", src="o", t=0.7).replace("k AS (SELECT min(id) AS id, g FROM", "k AS (SELECT arg_min(id, (-score, id)) AS id, min(id) AS cls, max(score) AS score, g FROM").replace("FROM (SELECT id, list_sort(g) AS g FROM g) GROUP BY g", "FROM (SELECT id, score, list_sort(g) AS g FROM g JOIN o USING (id)) GROUP BY g").replace("p AS (SELECT a.id AS a, b.id AS b,", "p AS (SELECT a.cls AS a, b.cls AS b, a.score AS sa, b.score AS sb,").replace("ON a.id < b.id", "ON a.cls < b.cls") + """
SELECT id FROM k WHERE cls NOT IN (SELECT CASE WHEN sa >= sb THEN b ELSE a END FROM p WHERE n / (x + y - n) >= 0.7)""")
def near_dup_keep(spark, d):
    """Conversation turns that lose to no similar turn; longer turns win."""
    t = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.length("text").alias("score"))
    return D.drop_near(t, "id", "text", "score").select("id")


@query("doc_near_dups")
def doc_near_dups(spark, d):
    """Pairs of whole documents at the operator's own threshold; no SQL, since all pairs of long sets are too slow there."""
    return D.similar_pairs(docs(spark, d), "doc_id", "text", 0.7).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("doc_near_dup_keep")
def doc_near_dup_keep(spark, d):
    """Documents that lose to no similar document; longer ones win."""
    t = docs(spark, d).select("doc_id", "text", F.length("text").alias("score"))
    return D.drop_near(t, "doc_id", "text", "score").select("doc_id")


@query("secret_scan", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, 'high' AS severity, 'generic_secret_assignment' AS pattern, substring(trim(line), 1, 180) AS snippet FROM l
WHERE regexp_matches(line, '(?i)\b(secret|token|password|passwd|api[_-]?key)\b\s*[:=]\s*[''"]?[A-Za-z0-9_\-/.+=]{8,}')
UNION ALL SELECT doc_id, line_no, 'critical', 'aws_access_key_id', substring(trim(line), 1, 180) FROM l WHERE regexp_matches(line, '\bAKIA[0-9A-Z]{16}\b')
UNION ALL SELECT doc_id, line_no, 'critical', 'openai_key', substring(trim(line), 1, 180) FROM l WHERE regexp_matches(line, '\bsk-[A-Za-z0-9]{20,}\b')
UNION ALL SELECT doc_id, line_no, 'critical', 'github_pat', substring(trim(line), 1, 180) FROM l WHERE regexp_matches(line, '\bghp_[A-Za-z0-9]{20,}\b')
UNION ALL SELECT doc_id, line_no, 'high', 'slack_token', substring(trim(line), 1, 180) FROM l WHERE regexp_matches(line, '\bxox[baprs]-[A-Za-z0-9-]{10,}\b')
UNION ALL SELECT doc_id, line_no, 'high', 'private_key_block', substring(trim(line), 1, 180) FROM l WHERE regexp_matches(line, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----')
UNION ALL SELECT doc_id, line_no, 'medium', 'jwt_like', substring(trim(line), 1, 180) FROM l WHERE regexp_matches(line, '\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b')""")
def secret_scan(spark, d):
    return S.scan_lines(docs(spark, d), ["doc_id"])


@query("severity_rollup", r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT count_if(regexp_matches(line, '(?i)\b(secret|token|password|passwd|api[_-]?key)\b\s*[:=]\s*[''"]?[A-Za-z0-9_\-/.+=]{8,}'))
+ count_if(regexp_matches(line, '\bxox[baprs]-[A-Za-z0-9-]{10,}\b')) + count_if(regexp_matches(line, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----')) AS h,
count_if(regexp_matches(line, '\bAKIA[0-9A-Z]{16}\b')) + count_if(regexp_matches(line, '\bsk-[A-Za-z0-9]{20,}\b')) + count_if(regexp_matches(line, '\bghp_[A-Za-z0-9]{20,}\b')) AS k,
count_if(regexp_matches(line, '\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b')) AS m FROM l)
SELECT k::BIGINT AS critical, h::BIGINT AS high, m::BIGINT AS medium, 0::BIGINT AS low, (k + h + m)::BIGINT AS total FROM c""")
def severity_rollup(spark, d):
    return S.severity_rollup(S.scan_lines(docs(spark, d), ["doc_id"]))


_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "phone_number": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}",
    "credit_card": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "date_of_birth": r"(?i)\b(?:date of birth|birth ?date|dob)\b", "health_data": r"(?i)\b(?:patient|diagnosis|medical record|prescription|symptoms)\b",
    "biometric": r"(?i)\b(?:fingerprint|face ?print|retina|iris scan|biometric)\b", "religion": r"(?i)\b(?:religion|religious)\b",
}


@query("pii_counts", "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INT) AS {n}" for n, p in _PII.items()) + " FROM documents")
def pii_counts(spark, d):
    return docs(spark, d).select("doc_id", *[c.alias(n) for n, c in S.pii_counts(F.col("text")).items()])


@query("redact", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\$\d[\d.,]*', '[redacted]', 'g'), '\d+', '[#]', 'g')) AS digest FROM documents")
def redact(spark, d):
    return docs(spark, d).select("doc_id", F.md5(S.redact_numbers(S.redact_money(F.col("text"))).cast("binary")).alias("digest"))


@query("pseudonymize", "SELECT c_custkey, substring(sha256('s1' || c_name), 1, 16) AS alias, CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) * 1000 AS VARCHAR) || '-' || CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) * 1000 + 999 AS VARCHAR) AS balance FROM customer")
def pseudonymize(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.pseudonym(F.col("c_name"), "s1").alias("alias"), S.generalized(F.col("c_acctbal"), 1000).alias("balance"))


@query("jaro_winkler", "SELECT a.n_name AS a, b.n_name AS b, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def jaro_winkler(spark, d):
    n = table(spark, d, "nation")
    a, b = (n.select(F.col("n_name").alias(c), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias(f"k{c}")) for c in "ab")
    return a.join(b, "r").filter("ka < kb").select("a", "b", F.round(D.jaro_winkler(F.col("a"), F.col("b")), 6).alias("similarity"))


# ------------------------------------------------------------- data quality


@query("profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def profile(spark, d):
    return Q.profile(table(spark, d, "orders"))


@query("dq_score", """
WITH x AS (SELECT avg((props IS NOT NULL)::INT) AS c, avg((json_extract_string(props, '$.k') IS NOT NULL)::INT) AS k, avg((event_type IN ('click', 'view', 'purchase', 'signup'))::INT) AS v, count(DISTINCT (user_id, event_type, CAST(ts AS DATE))) / count(*) AS u,
avg((ts BETWEEN TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR AND TIMESTAMP '2024-01-31')::INT) AS t FROM events),
s AS (SELECT 100 * (0.3 * c + 0.25 * k + 0.2 * v + 0.15 * u + 0.1 * t) AS s, t FROM x)
SELECT round(t, 6) AS timeliness, round(s, 4) AS score, CASE WHEN s >= 85 THEN 'good' WHEN s >= 65 THEN 'fair' ELSE 'poor' END AS band FROM s""")
def dq_score(spark, d):
    """Events: all five dimensions from the data; timely is what is not older than ten days at the end of the month."""
    kept = F.count_distinct("user_id", "event_type", F.to_date("ts")) / F.count("*")
    x = table(spark, d, "events").agg(
        F.avg(F.col("props").isNotNull().cast("int")).alias("completeness"), F.avg(F.get_json_object("props", "$.k").isNotNull().cast("int")).alias("consistency"),
        F.avg(F.col("event_type").isin("click", "view", "purchase", "signup").cast("int")).alias("validity"), kept.alias("uniqueness"), Q.timely_share(F.col("ts"), F.lit("2024-01-31"), 240).alias("timeliness"),
    )
    s = Q.quality_score({c: F.col(c) for c in Q.WEIGHTS})
    return x.select(F.round("timeliness", 6).alias("timeliness"), F.round(s, 4).alias("score"), Q.band(s).alias("band"))


_IQR = """
WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 97 = 0 THEN value * 9 ELSE value END AS value FROM events), q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM e GROUP BY 1)
SELECT event_id, value < a - {f} * (b - a) OR value > b + {f} * (b - a) AS outlier FROM e JOIN q USING (event_type)"""


def _spiked(spark, d):
    """Events with a value in 97 made nine times as large, so that there are outliers."""
    return table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 97 == 0, F.col("value") * 9).otherwise(F.col("value")).alias("value"))


@query("iqr_outliers", _IQR.format(f=1.5))
def iqr_outliers(spark, d):
    return Q.with_iqr_outliers(_spiked(spark, d), ["event_type"], "value").select("event_id", "outlier")


@query("iqr_outliers_narrow", _IQR.format(f=0.2))
def iqr_outliers_narrow(spark, d):
    return Q.with_iqr_outliers(_spiked(spark, d), ["event_type"], "value", 0.2).select("event_id", "outlier")


_SPIKED = "e AS (SELECT event_id, event_type, CASE WHEN event_id % 97 = 0 THEN value * 9 ELSE value END AS value FROM events)"


@query("z_scores", "WITH " + _SPIKED + " SELECT event_id, round((value - m) / s, 6) AS z, abs((value - m) / s) > 3 AS z_outlier FROM e JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM e GROUP BY 1) USING (event_type)")
def z_scores(spark, d):
    return Q.with_z_scores(_spiked(spark, d), ["event_type"], "value").select("event_id", F.round("z", 6).alias("z"), "z_outlier")


@query("mad_outliers", "WITH " + _SPIKED + """, m AS (SELECT event_type, median(value) AS med FROM e GROUP BY 1), g AS (SELECT event_id, event_type, abs(value - med) AS g FROM e JOIN m USING (event_type)), a AS (SELECT event_type, median(g) AS mad FROM g GROUP BY 1)
SELECT event_id, round(0.6745 * g / mad, 6) AS modified_z, 0.6745 * g / mad > 3.5 AS z_outlier FROM g JOIN a USING (event_type)""")
def mad_outliers(spark, d):
    return Q.with_modified_z(_spiked(spark, d), ["event_type"], "value").select("event_id", F.round("modified_z", 6).alias("modified_z"), "z_outlier")


@query("impute_median", """
WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events), m AS (SELECT event_type, median(v) AS med FROM e GROUP BY 1)
SELECT event_id, round(coalesce(v, med), 6) AS v, v IS NULL AS v_missing FROM e JOIN m USING (event_type)""")
def impute_median(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return Q.imputed(e, "v", "median", ["event_type"]).select("event_id", F.round("v", 6).alias("v"), "v_missing")


@query("impute_mode", """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS s, p_brand FROM part), n AS (SELECT p_brand, s, count(*) AS n FROM p WHERE s IS NOT NULL GROUP BY 1, 2),
m AS (SELECT p_brand, s AS fill FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, s) = 1) SELECT p_partkey, coalesce(s, fill) AS s FROM p LEFT JOIN m USING (p_brand)""")
def impute_mode(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("s"))
    return Q.imputed(p, "s", "mode", ["p_brand"]).select("p_partkey", "s")


@query("fk_check", "SELECT 'lineitem' AS child, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)")
def fk_check(spark, d):
    some = table(spark, d, "orders").filter("o_orderkey % 10 <> 0")  # parents that are there, for the sake of the check
    return Q.orphans(table(spark, d, "lineitem"), "l_orderkey", some, "o_orderkey").agg(F.lit("lineitem").alias("child"), F.count("*").alias("n"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return Q.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("quarantine", "SELECT s_suppkey, concat_ws(',', CASE WHEN NOT s_acctbal >= 0 THEN 'balance' END, CASE WHEN NOT s_nationkey < 20 THEN 'nation' END) AS broken FROM supplier")
def quarantine(spark, d):
    q = Q.quarantined(table(spark, d, "supplier"), {"balance": F.col("s_acctbal") >= 0, "nation": F.col("s_nationkey") < 20})
    return q.select("s_suppkey", F.array_join("broken_rules", ",").alias("broken"))


@query("freshness", """
WITH a AS (SELECT event_type, (epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(max(ts)))) / 3600.0 AS h FROM events GROUP BY 1)
SELECT event_type, round(h, 6) AS age_hours, CASE WHEN h >= 14 THEN 'error' WHEN h >= 13 THEN 'warn' ELSE 'ok' END AS state FROM a""")
def freshness(spark, d):
    return Q.freshness(table(spark, d, "events"), "ts", F.lit("2024-01-30 12:00:00"), 13, 14, by=["event_type"]).select("event_type", F.round("age_hours", 6).alias("age_hours"), "state")


@query("silent_failures", "SELECT count_if(lower(trim(props)) IN ('', 'n/a')) ::BIGINT AS n_sentinel, count_if(props <> trim(props))::BIGINT AS n_outer_space, count_if(regexp_matches(trim(props), '^[+-]?\\d+(\\.\\d+)?$'))::BIGINT AS n_numeric_text FROM events")
def silent_failures(spark, d):
    return table(spark, d, "events").agg(*[c.alias(n) for n, c in Q.silent_failures(F.col("props")).items()])


# ------------------------------------------------------------ conversations


@query("conv_turn_stats", "SELECT conv_id, count(*) AS n_turns, count_if(role = 'user')::BIGINT AS n_user, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def conv_turn_stats(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"))


@query("role_alternation", "SELECT conv_id, count_if(role = b)::BIGINT AS n_repeats FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) GROUP BY 1")
def role_alternation(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").withColumn("b", F.lag("role").over(w)).groupBy("conv_id").agg(F.count_if(F.col("role") == F.col("b")).alias("n_repeats"))


@query("conv_last_n", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def conv_last_n(spark, d):
    from quern.sources.tables import tail_by

    return tail_by(table(spark, d, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn")
