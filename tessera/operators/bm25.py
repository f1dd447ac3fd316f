"""Keyword ranking: terms with identifier parts, statistics, BM25 scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from . import passes

K1, B = 1.2, 0.75
#: Distinct terms of queries up to which they are a filter of the scan.
MOST_TERMS = 2000
#: Queries up to which they are split on the driver.
MOST_QUERIES = 4096


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, word)``: words of each text by position; null and wordless texts give no rows."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(T.words(F.col(text_col))).alias("pos", "word"))


def term_frequencies(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``(id, term, tf)`` with words in lower case and the parts of identifiers, of texts with unique ids.

    A word counts each time it stands in the text. A part counts once, and only
    if it comes before any such word. Null and wordless texts give no rows.
    """
    return passes.term_rows(docs, id_col, text_col).select("id", "term", "tf")


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``(term, id, tf, doc_len)`` in the order of terms, for storing: a search reads the row groups of its own terms."""
    return passes.term_rows(docs, id_col, text_col).select("term", "id", "tf", "doc_len")


def clustered(post: DataFrame) -> DataFrame:
    """Postings by ranges of terms, sorted within; a frequent term is split over several files by id."""
    return post.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def doc_lengths(tf: DataFrame) -> DataFrame:
    """``(id, doc_len)`` in terms, parts included."""
    return tf.groupBy("id").agg(F.sum("tf").alias("doc_len"))


def doc_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(tf: DataFrame) -> DataFrame:
    """One row ``(n_docs, avg_len)``; texts without terms don't exist here."""
    return doc_lengths(tf).agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """``(query_id, term, qtf)``; a repeated word of a query scores again."""
    return term_frequencies(queries, id_col, text_col).toDF("query_id", "term", "qtf")


def few_terms(queries: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """The terms of the queries, and the distinct ones as a list; None for it where there are more than MOST_TERMS.

    A stated set of up to MOST_QUERIES queries is split on the driver.
    """
    rows = queries.where("query is not null").select("query_id", T.words(F.col("query")).alias("words")).limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        return query_terms(queries), None
    parts = passes.Kept(passes.parts_of)
    terms = [(r["query_id"], t, n) for r in rows for t, n in passes.term_counts(r["words"], parts).items()]
    few = sorted({t for _, t, _ in terms})
    return queries.sparkSession.createDataFrame(terms, f"query_id {dict(queries.dtypes)['query_id']}, term string, qtf bigint"), few if len(few) <= MOST_TERMS else None


def search_texts(docs: DataFrame, queries: DataFrame, limit: int | None = 10, id_col: str = "id", text_col: str = "content", **how) -> DataFrame:
    """``search`` over texts that have no stored postings.

    One pass counts the terms of each text and lets out the postings of the
    queries' terms and the lengths; nothing else is written. For more than
    MOST_TERMS distinct terms of queries all postings are made and joined.
    """
    asked = few_terms(queries)
    if asked[1] is None:
        return search(materialize(postings(docs, id_col, text_col), "postings"), queries, limit, asked=asked, **how)
    got = materialize(passes.term_rows(docs, id_col, text_col, asked[1]), "postings")
    stats = got.where("term is null").agg(F.sum("tf").alias("n_docs"), (F.sum("doc_len") / F.sum("tf")).alias("avg_len"))
    return search(got.where("term is not null"), queries, limit, stats=stats, asked=asked, **how)


def search(tf: DataFrame, queries: DataFrame, limit: int | None = 10, k1: float = K1, b: float = B, rank_ties: str = "id", stats: DataFrame | None = None, asked: tuple | None = None) -> DataFrame:
    """``(query_id, id, score, rank)`` of the best documents of each query.

    ``tf(id, term, tf[, doc_len])`` are postings, with ``stats`` one row ``(n_docs,
    avg_len)`` of the corpus where it is known. Ties go to the smaller id. Only
    postings of query terms are read where these are few: the terms are a filter
    of the scan, which skips row groups of stored postings. Document lengths and
    statistics cover the whole corpus.
    """
    q, few = asked or few_terms(queries)
    if "doc_len" not in tf.columns:
        tf = materialize(tf, "postings")
        tf = tf.join(doc_lengths(tf), "id")
    # a bounded list of terms; beyond it a join
    hits = tf.where(F.col("term").isin(few)) if few is not None else tf.join(q.select("term").distinct(), "term", "left_semi")
    row = (stats if stats is not None else corpus_stats(tf)).first()
    # no row: nothing is stored
    n_docs, avg_len = (row["n_docs"] or 0, float(row["avg_len"] or 0)) if row else (0, 0.0)
    n_docs, avg_len = F.lit(n_docs), F.lit(max(1.0, avg_len))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    post = hits.join(df.join(q, "term"), "term")
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    length = 1 - b + b * F.col("doc_len") / avg_len
    one = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    scored = post.groupBy("query_id", "id").agg(F.sum(one).alias("score"))
    # scores are compared to 9 places, so that the order of summing can't change a rank
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), rank_ties)))
    return ranked.where(F.col("rank") <= limit) if limit else ranked
