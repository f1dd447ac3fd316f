"""Queries of the text operators, each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize, table
from . import encode, handwritten, imi, neardup, pack, spans, split

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


@_query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of similar content."""
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "chunks")).select("id_a", "id_b")


@_query
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with its class of equal shingle sets, under the class's smallest id, and the class's links."""
    return neardup.near_duplicate_summary(table(spark, sf_dir, "chunks"), smallest=True)


@_query
def p1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys of the near-duplicate index are combinations of shingles."""
    return neardup.key_report(table(spark, sf_dir, "chunks"))


@_query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share a long passage."""
    return spans.shared_pairs(table(spark, sf_dir, "documents")).toDF("doc_id_a", "doc_id_b")


@_query
def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands elsewhere too."""
    return spans.shared_share(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query
def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared stretches of each document."""
    return spans.shared_spans(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of high cosine of which one is among the other's ten nearest."""
    return imi.similar_pairs(table(spark, sf_dir, "features")).toDF("vector_id_a", "vector_id_b")


@_query
def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector."""
    return imi.nearest(table(spark, sf_dir, "features"))


@_query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand."""
    return handwritten.machine_files(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "packages"))


@_query
def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its kinds and the shares they rest on."""
    return handwritten.classify_files(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "packages"))


@_query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks above a limit, by their pieces."""
    return split.split_oversized(table(spark, sf_dir, "chunks")).where("piece = 0").select("id")


@_query
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all chunks above a limit."""
    return split.split_oversized(table(spark, sf_dir, "chunks"))


@_query
def p5_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of each chunk that is cut."""
    chunks = table(spark, sf_dir, "chunks")
    return split.misfits(split.split_oversized(chunks), chunks)


@_query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


@_query
def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, from its ids."""
    return encode.decode_corpus(encode.encode_corpus(table(spark, sf_dir, "documents")))


@_query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of each piece of each document."""
    return pack.pack(encode.token_counts(table(spark, sf_dir, "documents")))


@_query
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, and the least there could be."""
    return pack.fill_report(pack.pack(encode.token_counts(table(spark, sf_dir, "documents"))))


@_query
def p7_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objective of the configuration program and the bound below it."""
    return pack.program_report(encode.token_counts(table(spark, sf_dir, "documents")))


@_query
def p7_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing, counted over all containers and documents."""
    counts = materialize(encode.token_counts(table(spark, sf_dir, "documents")), "counts")
    return pack.misfits(pack.pack(counts), counts).withColumnRenamed("items", "documents")


def queries() -> dict[str, Query]:
    return dict(_ALL)


_SHINGLES = """sh AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM
    (SELECT id, list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM (SELECT DISTINCT id, content FROM chunks WHERE id IS NOT NULL)) WHERE len(w) >= 30)),
    n AS (SELECT id, count(*) AS n FROM sh GROUP BY id)"""
_WINDOWS = """d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 150),
    w AS (SELECT doc_id, i, hash(substr(text, i, 150)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 148)) AS i FROM d))"""


def oracle_sql() -> dict[str, str]:
    """SQL by brute force, for the sizes that tests use."""
    usable = "SELECT DISTINCT vector_id, space, vector::DOUBLE[] AS v FROM features WHERE vector_id IS NOT NULL AND len(vector) = CASE space WHEN 'BinaryFingerprint' THEN 256 WHEN 'Text' THEN 64 WHEN 'Code' THEN 64 END AND NOT list_contains(list_transform(vector, lambda x: isnan(x)), true) AND list_sum(list_transform(vector, lambda x: abs(x))) > 0"
    return {
        "p1_found": f"""WITH {_SHINGLES} SELECT id_a, id_b FROM (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
            JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9""",
        "p1_classes": f"""WITH {_SHINGLES}, k AS (SELECT id, list_sort(list(s)) AS k, CAST(count(*) AS INT) AS n FROM sh GROUP BY id), c AS (SELECT k, min(id) AS class_id, any_value(n) AS n, count(*) AS copies FROM k GROUP BY k),
            r AS (SELECT class_id, n, unnest(k) AS s FROM c), p AS (SELECT a.class_id AS x, b.class_id AS y FROM r a JOIN r b ON a.s = b.s AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9),
            l AS (SELECT x AS class_id, count(*) AS links FROM p GROUP BY x)
            SELECT k.id, c.class_id, c.n, c.copies, coalesce(l.links, 0) AS links FROM k JOIN c USING (k) LEFT JOIN l USING (class_id)""",
        "p3_found": f"""WITH u AS ({usable}), c AS (SELECT a.vector_id AS x, b.vector_id AS y, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM u a JOIN u b ON a.space = b.space AND a.vector_id <> b.vector_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS r FROM c)
            SELECT DISTINCT least(x, y) AS vector_id_a, greatest(x, y) AS vector_id_b FROM r WHERE r <= 10 AND c >= 0.85""",
        "p3_neighbours": f"""WITH u AS ({usable}), c AS (SELECT a.vector_id AS id, a.space, b.vector_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.space = b.space AND a.vector_id <> b.vector_id)
            SELECT id, space, neighbour, cosine, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY space, id ORDER BY cosine DESC, neighbour) AS rank FROM c) WHERE rank <= 10""",
        "p5_found": r"""
            SELECT id FROM chunks
            WHERE id IS NOT NULL AND (length(content) > 4000 OR len(regexp_extract_all(content, '[^ \t\r\n]+')) > 320)
            GROUP BY id
        """,
        "p5_fits": r"""WITH b AS (SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL AND (length(content) > 4000 OR len(regexp_extract_all(content, '[^ \t\r\n]+')) > 320))
            SELECT id, 0::BIGINT AS too_large, 0::BIGINT AS miscounted, 0::BIGINT AS wrong_overlap, 0::BIGINT AS not_whole, 0::BIGINT AS wrong_lines FROM b""",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p7_fits": "SELECT count(*) AS documents, count(*) FILTER (length(text) > 0) AS sized, 0::BIGINT AS overfull, 0::BIGINT AS cut, 0::BIGINT AS lost, 0::BIGINT AS gaps, true AS filled FROM documents",
        "p8_found": f"WITH {_WINDOWS}, x AS (SELECT DISTINCT doc_id, h FROM w) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id",
        "p8_spans": f"""WITH {_WINDOWS}, m AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), s AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w WHERE h IN (SELECT h FROM m)),
            g AS (SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s)
            SELECT doc_id, CAST(min(i) - 1 AS BIGINT) AS start, CAST(max(i) + 149 AS BIGINT) AS end FROM g GROUP BY doc_id, k""",
        "p8_share": f"""WITH {_WINDOWS}, m AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap FROM w WHERE h IN (SELECT h FROM m)),
            t AS (SELECT doc_id, sum(CASE WHEN gap IS NULL OR gap > 150 THEN 1 ELSE 0 END) AS spans, sum(least(150, coalesce(gap, 150))) AS chars FROM s GROUP BY doc_id)
            SELECT doc_id, length(text) AS n_chars, CAST(coalesce(spans, 0) AS BIGINT) AS spans, CAST(coalesce(chars, 0) AS BIGINT) AS shared_chars, round(coalesce(chars / length(text)::DOUBLE, 0), 6) AS share FROM documents LEFT JOIN t USING (doc_id)""",
    }
