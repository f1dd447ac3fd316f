"""Queries of text functions, keyword statistics and search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import bm25, evaluate, retrieval, updates
from ..session import materialize, table
from ..sources import parsers
from .catalog import query

#: The queries of single searches; fixed texts.
SEARCHES = ((1, "snapshot reader of the durable commit"), (2, "merge_section SnapshotReader parse"), (3, "query planner planner fixture"), (4, "route the hybrid cache"))

CH = "ch AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1)"
W = r"wd AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT id, regexp_extract_all(content, '[\p{L}\p{N}_]+') AS ws FROM ch WHERE content IS NOT NULL))"


def _cut(word: str) -> str:
    return rf"regexp_replace(regexp_replace({word}, '(\p{{Ll}})(\p{{Lu}})', '\1|\2', 'g'), '([^|_])(\p{{Lu}}\p{{Ll}})', '\1|\2', 'g')"


def _terms(words: str, ident: str) -> str:
    """CTEs from ``words(ident, pos, word)`` to ``{words}_tf(ident, term, tf)``."""
    return rf"""
    {words}_p AS (SELECT {ident}, pos, word, unnest(list_filter(string_split(word, '_'), lambda x: x <> '')) AS piece FROM {words}),
    {words}_a AS (SELECT {ident}, lower(piece) AS term, pos FROM {words}_p WHERE contains(word, '_')
        UNION ALL SELECT {ident}, lower(unnest(list_filter(string_split({_cut('piece')}, '|'), lambda x: x <> ''))), pos FROM {words}_p),
    {words}_s AS (SELECT {ident}, term, min(pos) AS s FROM {words}_a GROUP BY ALL),
    {words}_f AS (SELECT {ident}, lower(word) AS term, count(*) AS n, min(pos) AS f FROM {words} GROUP BY ALL),
    {words}_tf AS (SELECT {ident}, term, CAST(tf AS BIGINT) AS tf FROM (SELECT coalesce(a.{ident}, b.{ident}) AS {ident}, coalesce(a.term, b.term) AS term,
        coalesce(n, 0) + CASE WHEN s IS NOT NULL AND (f IS NULL OR s < f) THEN 1 ELSE 0 END AS tf
        FROM {words}_f a FULL JOIN {words}_s b ON a.{ident} = b.{ident} AND a.term = b.term) WHERE tf > 0)"""


TF = f"{CH}, {W}, {_terms('wd', 'id')}"
QUERIES_SQL = "qs AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SEARCHES) + ") AS t(query_id, query))"
QW = r"qw AS (SELECT query_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT query_id, regexp_extract_all(query, '[\p{L}\p{N}_]+') AS ws FROM qs))"
BM25 = f"""{TF}, {QUERIES_SQL}, {QW}, {_terms('qw', 'query_id')},
    dl AS (SELECT id, sum(tf) AS n FROM wd_tf GROUP BY id), st AS (SELECT count(*) AS nd, greatest(avg(n), 1) AS av FROM dl),
    df AS (SELECT term, count(*) AS df FROM wd_tf GROUP BY term),
    sc AS (SELECT q.query_id, t.id, sum(q.tf * ln((nd - df + 0.5) / (df + 0.5) + 1) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * dl.n / av))) AS score
        FROM qw_tf q JOIN wd_tf t USING (term) JOIN df USING (term) JOIN dl ON dl.id = t.id, st GROUP BY ALL),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc)"""
EMB = r"""{src}_t AS (SELECT {ident}, list_transform(list_filter(string_split(regexp_replace(regexp_replace(array_to_string(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+'), ' '), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '([^ ])(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), ' '), lambda x: x <> ''), lambda x: lower(x)) AS t FROM {src} WHERE {text} IS NOT NULL),
    {src}_fc AS (SELECT {ident}, feature, sum(w) AS c FROM (
        SELECT {ident}, unnest(t) AS feature, 1.0 AS w FROM {src}_t
        UNION ALL SELECT {ident}, 'c3_' || substr(tok, i, 3), 0.5 FROM (SELECT {ident}, tok, unnest(range(1, length(tok) - 1)) AS i FROM (SELECT {ident}, unnest(t) AS tok FROM {src}_t) WHERE length(tok) >= 3)
        UNION ALL SELECT {ident}, t[i] || '_' || t[i + 1], 1.5 FROM (SELECT {ident}, t, unnest(range(1, len(t))) AS i FROM {src}_t WHERE len(t) >= 2)) GROUP BY ALL),
    {src}_b AS (SELECT {ident}, (('0x' || substr(md5(feature), 1, 8))::BIGINT >> 1) % 256 AS bucket, sum(CASE WHEN ('0x' || substr(md5(feature), 1, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(c))) AS v FROM {src}_fc GROUP BY ALL),
    {src}_v AS (SELECT {ident}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {ident})) AS value FROM {src}_b)"""
CODE = "(" + ", ".join(f"'{x}'" for x in retrieval.CODE_EXTENSIONS) + ")"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return updates.latest(table(spark, d, "chunks"), "id")


def _tf(spark: SparkSession, d: str) -> DataFrame:
    return bm25.term_frequencies(_chunks(spark, d))


def _searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEARCHES), "query_id int, query string")


@query("bm25_tokenize", f"WITH {CH}, {W} SELECT lower(word) AS word, count(*) AS n FROM wd GROUP BY ALL")
def bm25_tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Words of all chunks with their counts."""
    return bm25.tokens(_chunks(spark, d), "id", "content").groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


@query(
    "subtoken_split",
    rf"""WITH {CH}, {W}, w AS (SELECT DISTINCT word FROM wd), p AS (SELECT word, unnest(list_filter(string_split(word, '_'), lambda x: x <> '')) AS piece FROM w)
    SELECT DISTINCT word, lower(part) AS part FROM (SELECT word, piece AS part FROM p WHERE contains(word, '_')
    UNION ALL SELECT word, unnest(list_filter(string_split({_cut('piece')}, '|'), lambda x: x <> '')) FROM p)""",
)
def subtoken_split(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each distinct word."""
    w = bm25.tokens(_chunks(spark, d), "id", "content").select("word").distinct()
    return w.select("word", F.explode(T.identifier_parts(F.col("word"))).alias("part"))


@query("bm25_term_freq", f"WITH {TF} SELECT id, term, tf FROM wd_tf")
def bm25_term_freq(spark: SparkSession, d: str) -> DataFrame:
    """Frequency of each term in each chunk."""
    return _tf(spark, d)


@query("bm25_doc_freq", f"WITH {TF} SELECT term, count(*) AS df FROM wd_tf GROUP BY term")
def bm25_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    """Number of chunks of each term."""
    return bm25.doc_frequencies(_tf(spark, d))


@query("bm25_corpus_stats", f"WITH {TF} SELECT count(*) AS n_docs, round(avg(n), 6) AS avg_len FROM (SELECT id, sum(tf) AS n FROM wd_tf GROUP BY id)")
def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number of chunks with terms and their mean length."""
    return bm25.corpus_stats(_tf(spark, d)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("bm25_search", f"WITH {BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """Best chunks of each search by BM25."""
    return bm25.search_texts(_chunks(spark, d), _searches(spark), 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("topk_bm25", f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm WHERE query_id = 1 AND rank <= 20")
def topk_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best chunks of one search."""
    q = _searches(spark).where("query_id = 1")
    return bm25.search_texts(_chunks(spark, d), q, None).orderBy(F.desc(F.round("score", 9)), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query("join_inner_postings", f"WITH {BM25} SELECT query_id, term, t.id, q.tf AS qtf, t.tf FROM qw_tf q JOIN wd_tf t USING (term)")
def join_inner_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the terms of each search."""
    q = bm25.query_terms(_searches(spark))
    return _tf(spark, d).join(q, "term").select("query_id", "term", "id", "qtf", "tf")


@query(
    "bm25_after_delete",
    f"""WITH {TF}, gone AS (SELECT id FROM ch WHERE file_path IN (SELECT file_path FROM documents JOIN ch ON false UNION ALL SELECT file_path FROM ch WHERE file_path LIKE '%.py'))
    SELECT term, count(*) AS df FROM wd_tf WHERE id NOT IN (SELECT id FROM gone) GROUP BY term""".replace("SELECT file_path FROM documents JOIN ch ON false UNION ALL ", ""),
)
def bm25_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies after all Python files went."""
    c = _chunks(spark, d)
    gone = c.where(F.endswith(F.col("file_path"), F.lit(".py"))).select("file_path").distinct()
    return bm25.doc_frequencies(bm25.term_frequencies(updates.remove_by(c, gone)))


@query("embed_tokenize", f"WITH {CH}, {EMB.format(src='ch', ident='id', text='content')} SELECT id, t AS tokens FROM ch_t")
def embed_tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that vectors are made of."""
    return _chunks(spark, d).where("content is not null").select("id", T.embed_tokens(F.col("content")).alias("tokens"))


@query("char_trigrams", f"WITH {CH}, {EMB.format(src='ch', ident='id', text='content')} SELECT feature, count(*) AS chunks FROM ch_fc WHERE feature LIKE 'c3\\_%' ESCAPE '\\' AND length(feature) = 6 GROUP BY feature")
def char_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Character trigrams with the number of chunks that have them."""
    return retrieval.feature_counts(_chunks(spark, d)).where(F.startswith(F.col("feature"), F.lit("c3_")) & (F.length("feature") == 6)).groupBy("feature").agg(F.count("*").alias("chunks"))


@query("word_bigrams", f"WITH {CH}, {EMB.format(src='ch', ident='id', text='content')} SELECT t[i] || '_' || t[i + 1] AS bigram, count(*) AS n FROM (SELECT t, unnest(range(1, len(t))) AS i FROM ch_t WHERE len(t) >= 2) GROUP BY ALL")
def word_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring tokens with their counts."""
    t = _chunks(spark, d).where("content is not null").select(F.explode(T.bigrams(T.embed_tokens(F.col("content")))).alias("bigram"))
    return t.groupBy("bigram").agg(F.count("*").alias("n"))


@query("feature_counts", f"WITH {CH}, {EMB.format(src='ch', ident='id', text='content')} SELECT id, feature, CAST(c AS DOUBLE) AS count FROM ch_fc")
def feature_counts(spark: SparkSession, d: str) -> DataFrame:
    """Weighted counts of features in each chunk."""
    return retrieval.feature_counts(_chunks(spark, d))


@query("feature_hash", f"WITH {CH}, {W} SELECT DISTINCT word, (('0x' || substr(md5(word), 1, 8))::BIGINT >> 1) % 256 AS bucket, CASE WHEN ('0x' || substr(md5(word), 1, 8))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM wd")
def feature_hash(spark: SparkSession, d: str) -> DataFrame:
    """Bucket and sign of each distinct word."""
    w = bm25.tokens(_chunks(spark, d), "id", "content").select("word").distinct()
    return w.select("word", V.feature_bucket(F.col("word"), 256).alias("bucket"), V.feature_sign(F.col("word")).alias("sign"))


@query("hash_embed", f"WITH {CH}, {EMB.format(src='ch', ident='id', text='content')} SELECT id, bucket, round(value, 6) AS value FROM ch_v")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """Non-zero places of each chunk's vector."""
    return retrieval.hash_buckets(_chunks(spark, d)).select("id", "bucket", F.round("value", 6).alias("value"))


@query(
    "hash_embed_dense",
    f"""WITH {CH}, {EMB.format(src='ch', ident='id', text='content')}, g AS (SELECT id, unnest(range(256)) AS bucket FROM ch)
    SELECT g.id, list(round(coalesce(v.value, 0), 5) + 0.0 ORDER BY g.bucket) AS vector FROM g LEFT JOIN ch_v v ON v.id = g.id AND v.bucket = g.bucket GROUP BY g.id""",
)
def hash_embed_dense(spark: SparkSession, d: str) -> DataFrame:
    """The vectors in full."""
    return retrieval.hash_embed(_chunks(spark, d)).select("id", F.transform("vector", lambda x: F.round(x, 5) + F.lit(0.0)).alias("vector"))


@query(
    "path_parts",
    rf"""WITH {CH}, p AS (SELECT DISTINCT file_path FROM ch WHERE file_path IS NOT NULL)
    SELECT file_path, regexp_extract(file_path, '[^/.][^/]*\.([^./]+)$', 1) AS ext, list_last(string_split(file_path, '/')) AS name,
    regexp_replace(list_last(string_split(file_path, '/')), '(.)\.[^.]*$', '\1') AS stem, regexp_replace('././' || file_path, '^(\./)+', '') AS clean FROM p""",
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Extension, name and stem of each path."""
    p = _chunks(spark, d).where("file_path is not null").select("file_path").distinct()
    c = F.col("file_path")
    return p.select("file_path", T.extension(c).alias("ext"), T.file_name(c).alias("name"), T.file_stem(c).alias("stem"), T.trim_dot_slash(F.concat(F.lit("././"), c)).alias("clean"))


@query("str_predicates", f"WITH {CH} SELECT ends_with(file_path, '.rs') AS is_rust, starts_with(file_path, 'm') AS from_m, contains(content, 'return') AS returns, count(*) AS n FROM ch GROUP BY ALL")
def str_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Prefix, suffix and substring tests."""
    return _chunks(spark, d).groupBy(F.endswith(F.col("file_path"), F.lit(".rs")).alias("is_rust"), F.startswith(F.col("file_path"), F.lit("m")).alias("from_m"), F.contains(F.col("content"), F.lit("return")).alias("returns")).agg(F.count("*").alias("n"))


@query("hit_preview", rf"WITH {CH} SELECT id, array_to_string(string_split(regexp_replace(regexp_replace(content, '\r\n', chr(10), 'g'), '\n$', ''), chr(10))[1:6], chr(10)) AS preview, substr(content, 1, 140) AS short FROM ch WHERE content IS NOT NULL")
def hit_preview(spark: SparkSession, d: str) -> DataFrame:
    """First lines of each chunk."""
    return _chunks(spark, d).where("content is not null").select("id", T.preview(F.col("content")).alias("preview"), F.substring("content", 1, 140).alias("short"))


@query("json_roundtrip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS again FROM events")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A JSON field read, written and read again."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("s"))
    return e.select("event_id", F.col("s.k").alias("k"), F.from_json(F.to_json("s"), "k bigint")["k"].alias("again"))


@query("tokens_approx", rf"WITH {CH} SELECT id, CAST(coalesce(len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')), 0) AS BIGINT) AS tokens FROM ch WHERE content IS NOT NULL")
def tokens_approx(spark: SparkSession, d: str) -> DataFrame:
    """Pieces between white space of each chunk."""
    return _chunks(spark, d).where("content is not null").select("id", T.token_count(F.col("content")).cast("bigint").alias("tokens"))


@query("feature_space_route", f"WITH {CH} SELECT id, CASE WHEN regexp_extract(file_path, '[^/.][^/]*\\.([^./]+)$', 1) IN {CODE} THEN 'Code' ELSE 'Text' END AS space FROM ch")
def feature_space_route(spark: SparkSession, d: str) -> DataFrame:
    """Space of each chunk by its extension."""
    return _chunks(spark, d).select("id", retrieval.feature_space(F.col("file_path")).alias("space"))


@query("generic_chunks", rf"""WITH {CH}, l AS (SELECT id, string_split(regexp_replace(regexp_replace(content, '\r\n', chr(10), 'g'), '\n$', ''), chr(10)) AS l FROM ch WHERE content IS NOT NULL AND content <> ''),
    s AS (SELECT id, l, unnest(range(0, greatest(0, CAST(ceil((len(l) - 50) / 40.0) AS BIGINT)) + 1)) * 40 AS o FROM l)
    SELECT id, CAST(o + 1 AS BIGINT) AS start_line, CAST(least(len(l), o + 50) AS BIGINT) AS end_line, array_to_string(l[o + 1:o + 50], chr(10)) AS content FROM s""")
def generic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 50 lines that share 10, of each chunk's text."""
    ls = _chunks(spark, d).where("content is not null and content <> ''").select("id", T.lines(F.col("content")).alias("l"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lines = b.column(1)[i].as_py()
                found = parsers.windows(lines)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(found)), pa.array([x.start for x in found]), pa.array([x.end for x in found]), pa.array(["\n".join(lines[x.start - 1 : x.end]) for x in found], pa.string())], ["id", "start_line", "end_line", "content"])

    return ls.mapInArrow(f, "id string, start_line bigint, end_line bigint, content string")


def _hybrid(spark: SparkSession, d: str, mode: str) -> DataFrame:
    h = retrieval.hybrid_search(_chunks(spark, d).select("id", "file_path", "content"), _searches(spark), 5, mode)
    return h.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


DENSE = f"""{EMB.format(src='ch', ident='id', text='content')}, {EMB.format(src='qs', ident='query_id', text='query')},
    dn AS (SELECT q.query_id, c.id, round(1 - sum(q.value * c.value), 6) AS distance FROM qs_v q JOIN ch_v c USING (bucket) GROUP BY ALL),
    ds AS (SELECT dn.*, CASE WHEN regexp_extract(file_path, '[^/.][^/]*\\.([^./]+)$', 1) IN {CODE} THEN 2 ELSE 1 END AS list_no FROM dn JOIN ch USING (id)),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY distance, id) AS rank FROM ds)"""


def _fuse_sql(words: bool, dense: bool) -> str:
    parts = (["SELECT query_id, id, rank, 0 AS list_no FROM bm WHERE rank <= 10"] if words else []) + (["SELECT query_id, id, rank, list_no FROM dr WHERE rank <= 10"] if dense else [])
    near = "dr" if dense else "(SELECT 0 AS query_id, '' AS id, 0.0 AS distance, 99 AS rank)"
    return f"""WITH {BM25}, {DENSE}, fu AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS rrf, min(list_no) AS best FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, best, id) AS rank FROM fu)
    SELECT f.query_id, f.id, f.rank, round(rrf, 9) AS rrf, round(CASE WHEN n.distance IS NULL THEN 50 * rrf ELSE greatest(1 - n.distance, 50 * rrf) END, 6) AS score,
    round(coalesce(n.distance, 1 - least(rrf, 1.0)), 6) AS distance FROM fr f LEFT JOIN {near} n ON n.query_id = f.query_id AND n.id = f.id AND n.rank <= 10 WHERE f.rank <= 5"""


@query("hybrid_search", _fuse_sql(True, True))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector lists fused by rank."""
    return _hybrid(spark, d, "hybrid")


@query("search_bm25_mode", _fuse_sql(True, False))
def search_bm25_mode(spark: SparkSession, d: str) -> DataFrame:
    """Fused search over the keyword list alone."""
    return _hybrid(spark, d, "bm25")


@query("search_dense_mode", _fuse_sql(False, True))
def search_dense_mode(spark: SparkSession, d: str) -> DataFrame:
    """Fused search over the vector lists alone."""
    return _hybrid(spark, d, "dense")


_MODES = (("bm25", True, False), ("dense", False, True), ("hybrid", True, True))


@query(
    "eval_modes",
    f"""WITH {CH}, {QUERIES_SQL}, h AS ({' UNION ALL '.join(f"SELECT '{m}' AS mode, query_id, id, rank FROM ({_fuse_sql(w, v)})" for m, w, v in _MODES)}),
    rel AS (SELECT query_id, id FROM qs JOIN ch ON ch.vector_id % 4 = query_id % 4), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
    g AS (SELECT mode, query_id, n, count(r.id) AS hits, min(CASE WHEN r.id IS NOT NULL THEN rank END) AS first FROM h JOIN n USING (query_id) LEFT JOIN rel r USING (query_id, id) GROUP BY ALL)
    SELECT mode, CASE WHEN query_id % 2 = 0 THEN 'exact' ELSE 'semantic' END AS kind, count(*) AS queries, round(avg(hits / n), 6) AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr,
        round(avg(CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_at_1 FROM g GROUP BY ALL""",
)
def eval_modes(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the searches by mode and kind, against a fixed labelling of all chunks."""
    c, q = _chunks(spark, d).select("id", "file_path", "content", "vector_id"), _searches(spark)
    rel = c.where("vector_id is not null").select("id", (F.col("vector_id") % 4).alias("m")).join(q.select("query_id", (F.col("query_id") % 4).cast("bigint").alias("m")), "m").select("query_id", "id", F.lit(1).alias("grade"))
    kinds = q.select("query_id", F.when(F.col("query_id") % 2 == 0, "exact").otherwise("semantic").alias("kind"))
    out = None
    for mode, _, _ in _MODES:
        m = evaluate.by_kind(evaluate.metrics(retrieval.hybrid_search(c, q, 5, mode), rel), kinds)
        m = m.select(F.lit(mode).alias("mode"), "kind", "queries", *(F.round(x, 6).alias(x) for x in ("recall_at_5", "mrr", "hit_at_1")))
        out = m if out is None else out.unionByName(m)
    return out


@query("rank_lists", f"WITH {BM25}, {DENSE} SELECT query_id, id, rank, CAST(list_no AS BIGINT) AS list_no FROM (SELECT query_id, id, rank, 0 AS list_no FROM bm UNION ALL SELECT query_id, id, rank, list_no FROM dr) WHERE rank <= 10")
def rank_lists(spark: SparkSession, d: str) -> DataFrame:
    """The three lists that are fused, with ranks."""
    c = _chunks(spark, d).select("id", "file_path", "content")
    q = _searches(spark)
    dense = retrieval.dense_lists(c, q, 10)
    lists = [bm25.search_texts(c, q, 10), dense["Text"], dense["Code"]]
    out = [x.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.lit(i).cast("bigint").alias("list_no")) for i, x in enumerate(lists)]
    return out[0].unionByName(out[1]).unionByName(out[2])


_RRF_SQL = """WITH a AS (SELECT id, row_number() OVER (ORDER BY tokens_approx DESC NULLS LAST, id) AS rank, 0 AS l FROM ch), b AS (SELECT id, row_number() OVER (ORDER BY length(content) DESC NULLS LAST, id) AS rank, 1 AS l FROM ch),
    f AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf, min(l) AS best FROM (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100) GROUP BY id)"""


def _two_lists(spark: SparkSession, d: str) -> DataFrame:
    c = materialize(_chunks(spark, d).select("id", "tokens_approx", F.length("content").alias("n")), "lists")
    from pyspark.sql import Window

    lists = []
    for col in ("tokens_approx", "n"):
        # the first hundred come from a distributed top-k; only these are numbered
        top = c.orderBy(F.col(col).desc_nulls_last(), "id").limit(100)
        lists.append(top.select(F.lit(1).alias("query_id"), "id", F.row_number().over(Window.orderBy(F.col(col).desc_nulls_last(), "id")).alias("rank")))
    return retrieval.rrf(lists)


@query("rrf_fuse", f"WITH {CH}, {_RRF_SQL[5:]} SELECT id, round(rrf, 9) AS rrf, CAST(best AS BIGINT) AS best_list FROM f")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists of chunks, by size, fused."""
    return _two_lists(spark, d).select("id", F.round("rrf", 9).alias("rrf"), F.col("best_list").cast("bigint").alias("best_list"))


@query("topk_rrf", f"WITH {CH}, {_RRF_SQL[5:]} SELECT id, round(rrf, 9) AS rrf FROM f ORDER BY round(f.rrf, 12) DESC, best, id LIMIT 20")
def topk_rrf(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best of the fused lists."""
    return _two_lists(spark, d).where("rank <= 20").select("id", F.round("rrf", 9).alias("rrf"))


@query("hit_scoring", f"WITH {CH}, {_RRF_SQL[5:]} SELECT id, round(50 * rrf, 6) AS score, round(1 - least(rrf, 1.0), 6) AS distance, round(greatest(0, least(100, 5000 * rrf)), 6) AS score_pct FROM f")
def hit_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Scores of hits that no vector list has."""
    f = retrieval.hit_scores(_two_lists(spark, d).withColumn("distance", F.lit(None).cast("double")))
    return f.select("id", *(F.round(c, 6).alias(c) for c in ("score", "distance", "score_pct")))


@query("llm_context", f"""WITH {BM25}, h AS (SELECT bm.*, ch.file_path, ch.start_line, ch.end_line, ch.content FROM bm JOIN ch USING (id) WHERE rank <= 5)
    SELECT query_id, string_agg('### ' || rank || '. ' || coalesce(file_path, '') || ':' || coalesce(start_line, 0) || '-' || coalesce(end_line, 0) || chr(10) || '```' || CASE regexp_extract(file_path, '[^/.][^/]*\\.([^./]+)$', 1)
    {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.FENCE_TAGS.items())} ELSE '' END || chr(10) || coalesce(content, '') || chr(10) || '```', chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id""")
def llm_context(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks of each search as one Markdown text."""
    c = _chunks(spark, d)
    h = bm25.search_texts(c, _searches(spark), 5).join(c, "id")
    z = F.lit(0)
    one = F.concat(F.lit("### "), "rank", F.lit(". "), F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce("start_line", z), F.lit("-"), F.coalesce("end_line", z), F.lit("\n```"), T.fence_tag(F.col("file_path")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n```"))
    g = h.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", one.alias("t")))).alias("x"))
    return g.select("query_id", F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("context"))
