"""Queries of the property graph and of commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cochange, graph, hierarchy
from ..session import materialize, table
from .catalog import query

ND = """nd AS (SELECT id, min(label) AS label, min(kind) AS kind, min(file_path) AS file_path, min(chunk_id) AS chunk_id, min(vector_id) AS vector_id FROM
    (SELECT id, label, kind, file_path, chunk_id, vector_id FROM nodes UNION ALL SELECT id, label, kind, file_path, NULL, NULL FROM shared_nodes) WHERE id IS NOT NULL GROUP BY id)"""
ED = r"""ek AS (SELECT source, target, lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) AS kind, weight, seq FROM edges),
    ed AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, target, kind ORDER BY seq) AS rn FROM ek
        WHERE source IN (SELECT id FROM nd) AND target IN (SELECT id FROM nd)) WHERE rn = 1)"""
G = f"{ND}, {ED}"
HUB, SEED = "file:mono/docs/operations.md", "symbol:mono/prelude/option.rs:unwrap_slot"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of both tables, each id once."""
    cols = ("id", "label", "kind", "file_path", "chunk_id", "vector_id")
    a = table(spark, d, "nodes").select(*cols)
    b = table(spark, d, "shared_nodes").select("id", "label", "kind", "file_path", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("bigint").alias("vector_id"))
    return a.unionByName(b).where("id is not null").groupBy("id").agg(*(F.min(c).alias(c) for c in cols[1:]))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Links that insertion accepts."""
    return graph.insert_valid(table(spark, d, "edges"), nodes(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "nodes").select("id").unionByName(table(spark, d, "shared_nodes").select("id"))
    return hierarchy.parent_links(table(spark, d, "edges"), ids=ids)


LINKS = r"""ids AS (SELECT id FROM nodes WHERE id IS NOT NULL UNION SELECT id FROM shared_nodes),
    al AS (SELECT CASE WHEN k = 'contains' THEN target ELSE source END AS child, CASE WHEN k = 'contains' THEN source ELSE target END AS parent
        FROM (SELECT source, target, lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) AS k FROM edges) WHERE k IN ('contains', 'belongsto')),
    lk AS (SELECT child, min(parent) AS parent FROM al WHERE child IN (SELECT id FROM ids) AND parent IN (SELECT id FROM ids) GROUP BY child),
    wk AS (SELECT child AS node, parent AS cur, 1 AS d, [child] AS path FROM lk
        UNION ALL SELECT node, lk.parent, d + 1, list_append(path, cur) FROM wk JOIN lk ON lk.child = wk.cur WHERE NOT list_contains(path, cur)),
    lp AS (SELECT DISTINCT node FROM wk WHERE list_contains(path, cur)),
    rt AS (SELECT DISTINCT parent AS node FROM lk WHERE parent NOT IN (SELECT child FROM lk))"""


@query(
    "p2_found",
    f"""WITH RECURSIVE {LINKS} SELECT node AS node_id, list_min(path[list_position(path, cur):]) AS root_id, CAST(-1 AS BIGINT) AS depth FROM wk WHERE list_contains(path, cur)
    UNION ALL SELECT node, cur, d FROM wk WHERE cur NOT IN (SELECT child FROM lk) UNION ALL SELECT node, node, 0 FROM rt""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of each node that lies in a hierarchy."""
    return hierarchy.resolve_roots(_links(spark, d))


@query(
    "p2_paths",
    f"""WITH RECURSIVE {LINKS} SELECT node AS node_id, node AS path, [node] AS path_ids, CAST(-1 AS BIGINT) AS depth, list_min(wk.path[list_position(wk.path, cur):]) AS root_id, true AS is_cyclic FROM wk WHERE list_contains(wk.path, cur)
    UNION ALL SELECT node, array_to_string(list_reverse(list_append(wk.path, cur)), ' > '), list_reverse(list_append(wk.path, cur)), d, cur, false FROM wk WHERE cur NOT IN (SELECT child FROM lk)
    UNION ALL SELECT node, node, [node], 0, node, false FROM rt""",
)
def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of each node, loops flagged."""
    links = _links(spark, d)
    return hierarchy.full_paths(links)


@query(
    "p2_descendants",
    f"""WITH RECURSIVE {LINKS} SELECT node AS node_id, cur AS ancestor_id, CAST(d AS BIGINT) AS distance FROM wk WHERE node NOT IN (SELECT node FROM lp)
    UNION ALL SELECT node, node, 0 FROM (SELECT child AS node FROM lk UNION SELECT node FROM rt)""",
)
def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each node of a tree with each of its ancestors, hence all descendants of each node."""
    links = _links(spark, d)
    return hierarchy.ancestor_pairs(links)


@query("node_lookup", f"WITH {ND} SELECT id, label, kind, file_path FROM nd WHERE chunk_id IS NOT NULL AND vector_id IS NOT NULL")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that have a chunk and a vector."""
    return nodes(spark, d).where("chunk_id is not null and vector_id is not null").select("id", "label", "kind", "file_path")


@query("edges_adjacent", f"WITH {G} SELECT source, target, kind, 'out' AS direction FROM ed WHERE source = '{HUB}' UNION ALL SELECT source, target, kind, 'in' FROM ed WHERE target = '{HUB}'")
def edges_adjacent(spark: SparkSession, d: str) -> DataFrame:
    """Links from and to one node."""
    e = edges(spark, d)
    cols = ("source", "target", "kind")
    return e.where(F.col("source") == HUB).select(*cols, F.lit("out").alias("direction")).unionByName(e.where(F.col("target") == HUB).select(*cols, F.lit("in").alias("direction")))


@query("find_symbols", f"WITH {ND} SELECT id, label, kind, file_path, lower(label) = 'commit' AS exact FROM nd WHERE contains(lower(label), 'commit')")
def find_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose label holds a text."""
    return graph.find_symbols(nodes(spark, d), "commit")


@query("topk_symbols", f"WITH {ND} SELECT id, label, kind, file_path FROM nd WHERE contains(lower(label), 'commit') ORDER BY lower(label) = 'commit' DESC, label, id LIMIT 20")
def topk_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty of them, equal labels first."""
    return graph.find_symbols(nodes(spark, d), "commit").limit(20).select("id", "label", "kind", "file_path")


@query("symbol_map", f"WITH {ND} SELECT label, list_sort(list(id)) AS ids FROM nd WHERE kind = 'Function' GROUP BY label")
def symbol_map(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the functions of each name."""
    return nodes(spark, d).where("kind = 'Function'").groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


@query("edge_dedup", r"SELECT source, target, kind, weight FROM (SELECT source, target, lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) AS kind, weight, row_number() OVER (PARTITION BY source, target, lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) ORDER BY seq) AS rn FROM edges) WHERE rn = 1")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first of equal links."""
    return graph.first_edges(table(spark, d, "edges")).select("source", "target", "kind", "weight")


@query("prune_dangling_edges", f"WITH {ND} SELECT seq FROM edges WHERE source IN (SELECT id FROM nd) AND target IN (SELECT id FROM nd)")
def prune_dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links both of whose ends exist."""
    return graph.prune_dangling(table(spark, d, "edges"), nodes(spark, d)).select("seq")


@query("join_semi_edges", f"WITH {ND} SELECT seq FROM edges WHERE source IN (SELECT id FROM nd)")
def join_semi_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links whose source exists."""
    return table(spark, d, "edges").join(nodes(spark, d).select(F.col("id").alias("source")), "source", "left_semi").select("seq")


@query("edge_insert_valid", f"WITH {G} SELECT source, target, kind, weight, seq FROM ed")
def edge_insert_valid(spark: SparkSession, d: str) -> DataFrame:
    """Links that inserting one by one accepts."""
    return edges(spark, d)


KHOP = f"""{G}, bo AS (SELECT source AS a, target AS b FROM ed UNION SELECT target, source FROM ed),
    h1 AS (SELECT DISTINCT b AS id FROM bo WHERE a = '{SEED}' AND b <> '{SEED}'),
    h2 AS (SELECT DISTINCT b AS id FROM bo WHERE a IN (SELECT id FROM h1) AND b <> '{SEED}' AND b NOT IN (SELECT id FROM h1)),
    kh AS (SELECT '{SEED}' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"""


def _khop(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.k_hop(materialize(edges(spark, d), "edges"), materialize(nodes(spark, d), "nodes"), spark.createDataFrame([(SEED,)], "id string"), 2)


@query("khop_nodes", f"WITH {KHOP} SELECT id, hop FROM kh")
def khop_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two links of a seed."""
    return _khop(spark, d)[0]


@query("khop_edges", f"WITH {KHOP} SELECT source, target, kind FROM ed WHERE source IN (SELECT id FROM kh WHERE hop < 2) OR target IN (SELECT id FROM kh WHERE hop < 2)")
def khop_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links met on the way, without those at the rim."""
    return _khop(spark, d)[1].select("source", "target", "kind")


_RELATED = f"""WITH {G}, r AS (SELECT source AS hit, target AS related, 0 AS prio, seq FROM ed WHERE kind IN ('calls', 'references', 'linksto', 'defines')
    UNION ALL SELECT target, source, 1, seq FROM ed WHERE kind = 'contains'),
    o AS (SELECT hit, related, min((prio, seq)) AS o FROM r WHERE hit <> related GROUP BY ALL)
    SELECT hit, related, rank FROM (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY o, related) AS rank FROM o WHERE hit IN (SELECT id FROM nd WHERE kind = 'Function')) WHERE rank <= 5"""


@query("context_expand", _RELATED)
def context_expand(spark: SparkSession, d: str) -> DataFrame:
    """Up to five related nodes of every function; ``context_expand_whole`` takes nodes of all kinds."""
    return graph.context_expand(edges(spark, d), nodes(spark, d).where("kind = 'Function'")).withColumn("rank", F.col("rank").cast("bigint"))


@query("context_expand_whole", _RELATED.replace("WHERE kind = 'Function'", ""))
def context_expand_whole(spark: SparkSession, d: str) -> DataFrame:
    """Up to five related nodes of every node."""
    return graph.context_expand(edges(spark, d), nodes(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


IMPACT = f"""{G}, tg AS (SELECT id FROM nd WHERE label = 'unwrap_slot'), bk AS (SELECT target AS id, source AS caller FROM ed WHERE kind IN ('calls', 'references', 'implements')),
    i1 AS (SELECT DISTINCT t.id AS target, caller AS id FROM tg t JOIN bk ON bk.id = t.id WHERE caller <> t.id),
    i2 AS (SELECT DISTINCT target, caller AS id FROM i1 JOIN bk ON bk.id = i1.id WHERE caller <> target AND (target, caller) NOT IN (SELECT target, id FROM i1)),
    im AS (SELECT id AS target, id, 0 AS depth FROM tg UNION ALL SELECT target, id, 1 FROM i1 UNION ALL SELECT target, id, 2 FROM i2)"""


def _impact(spark: SparkSession, d: str) -> DataFrame:
    n = materialize(nodes(spark, d), "nodes")
    return graph.impact(materialize(edges(spark, d), "edges"), n, n.where("label = 'unwrap_slot'"), 2)


@query("impact_callers", f"WITH {IMPACT} SELECT target, id, depth FROM im WHERE depth > 0")
def impact_callers(spark: SparkSession, d: str) -> DataFrame:
    """Who depends on a symbol, directly and at second hand."""
    return _impact(spark, d).where("depth > 0")


@query("impact_files", f"WITH {IMPACT} SELECT DISTINCT target, file_path FROM im JOIN nd ON nd.id = im.id WHERE file_path IS NOT NULL AND file_path <> ''")
def impact_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that a change of the symbol affects."""
    return graph.affected_files(_impact(spark, d), nodes(spark, d))


@query("impact_resolve", f"WITH {ND} SELECT q, id FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY (id = q) DESC, (lower(label) = lower(q)) DESC, label, id) AS r FROM (VALUES ('{SEED}'), ('as_key'), ('trace')) AS t(q), nd WHERE id = q OR contains(lower(label), lower(q))) WHERE r = 1")
def impact_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The node that each text means: an id, else the first symbol found."""
    n = nodes(spark, d).select("id", "label")
    means = lambda q: F.when((F.col("id") == q) | F.contains(F.lower("label"), F.lit(q.lower())), q)
    hit = n.select("id", "label", F.explode(F.array_compact(F.array(*map(means, (SEED, "as_key", "trace"))))).alias("q"))
    w = Window.partitionBy("q").orderBy(F.desc(F.col("id") == F.col("q")), F.desc(F.lower("label") == F.lower("q")), "label", "id")
    return hit.withColumn("r", F.row_number().over(w)).where("r = 1").select("q", "id")


@query("graph_remove_file", f"WITH {G}, gone AS (SELECT id FROM nd WHERE file_path = 'mono/docs/operations.md') SELECT 'node' AS what, count(*) AS n FROM nd WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edge', count(*) FROM ed WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)")
def graph_remove_file(spark: SparkSession, d: str) -> DataFrame:
    """What stays when the largest file goes."""
    gone = spark.createDataFrame([("mono/docs/operations.md",)], "file_path string")
    n, e = graph.remove_file(nodes(spark, d), edges(spark, d), gone)
    return n.agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "n").unionByName(e.agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "n"))


@query("engine_stats", f"WITH {G} SELECT (SELECT count(DISTINCT id) FROM chunks) AS chunks, (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges, (SELECT count(DISTINCT vector_id) FROM features) AS features")
def engine_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of chunks, nodes, links and features."""
    one = lambda df, c: df.agg(F.count("*").alias(c))
    c = table(spark, d, "chunks").agg(F.countDistinct("id").alias("chunks"))
    f = table(spark, d, "features").agg(F.countDistinct("vector_id").alias("features"))
    rows = c.unionByName(one(nodes(spark, d), "nodes"), True).unionByName(one(edges(spark, d), "edges"), True).unionByName(f, True)
    return rows.agg(*(F.max(x).alias(x) for x in ("chunks", "nodes", "edges", "features")))


CF = "cf AS (SELECT hash, min(seq) AS seq, file FROM (SELECT hash, seq, unnest(files) AS file FROM commits WHERE hash IS NOT NULL) WHERE file IS NOT NULL GROUP BY hash, file)"


@query("cochange_file_counts", f"WITH {CF} SELECT file, count(*) AS commits FROM cf GROUP BY file")
def cochange_file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Commits of each file."""
    return cochange.file_counts(table(spark, d, "commits"))


@query(
    "cochange_candidates",
    f"""WITH {CF}, tg AS (SELECT DISTINCT hash FROM cf WHERE file = 'mono/docs/operations.md' OR ends_with(file, '/mono/docs/operations.md')),
    bo AS (SELECT * FROM cf WHERE hash IN (SELECT hash FROM tg) AND file <> 'mono/docs/operations.md' AND NOT ends_with(file, '/mono/docs/operations.md')),
    lb AS (SELECT hash, arg_max(subject, seq) AS subject FROM commits WHERE hash IS NOT NULL GROUP BY hash),
    rk AS (SELECT file, concat_ws(' ', hash, subject) AS l, row_number() OVER (PARTITION BY file ORDER BY seq DESC, hash) AS r FROM bo JOIN lb USING (hash))
    SELECT file, count(*) AS together, (SELECT count(*) FROM tg) AS total, count(*) / (SELECT count(*)::DOUBLE FROM tg) AS confidence, list(l ORDER BY r) FILTER (WHERE r <= 3) AS recent FROM rk GROUP BY file""",
)
def cochange_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Files that change together with the busiest one."""
    return cochange.candidates(table(spark, d, "commits"), "mono/docs/operations.md")


_PAIRS = f"""WITH {CF}, n AS (SELECT file, count(*) AS n FROM cf GROUP BY file),
    p AS (SELECT x.file AS a, y.file AS b, count(*) AS together FROM cf x JOIN cf y ON x.hash = y.hash AND x.file < y.file GROUP BY ALL HAVING count(*) >= {{least}})
    SELECT a, b, together, round(together / (na.n + nb.n - together)::DOUBLE, 6) AS jaccard FROM p JOIN n na ON na.file = a JOIN n nb ON nb.file = b"""


@query("cochange_edges", _PAIRS.format(least=2))
def cochange_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files that share at least two commits."""
    return cochange.pairs(table(spark, d, "commits"), 2).withColumn("jaccard", F.round("jaccard", 6))


@query("join_self_cochange", _PAIRS.format(least=1))
def join_self_cochange(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files that share a commit."""
    return cochange.pairs(table(spark, d, "commits"), 1).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "call_candidates",
    f"""WITH {ND}, ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1),
    cl AS (SELECT DISTINCT node_id AS source, unnest(regexp_extract_all(regexp_replace(content, '\\b(fn|def)[ \\t]+\\w+\\s*\\(', ' ', 'g'), '\\b(\\w+)\\s*\\(', 1)) AS label FROM ch WHERE content IS NOT NULL AND node_id IS NOT NULL)
    SELECT DISTINCT source, id AS target FROM cl JOIN nd ON nd.label = cl.label WHERE nd.kind = 'Function' AND strlen(cl.label) >= 4 AND source <> id""",
)
def call_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Chunks' nodes that call a name, with every function of that name."""
    from ..operators import updates
    from ..sources import parsers

    c = updates.latest(table(spark, d, "chunks"), "id").where("node_id is not null").select("node_id", "content")
    return parsers.call_candidates(c, nodes(spark, d).where("kind = 'Function'"))
