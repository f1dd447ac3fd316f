import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import ORACLE

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks nodes shared_nodes edges features commits packages".split()
SOME = ["bm25_search", "hybrid_search", "context_expand", "khop_edges", "cochange_candidates", "snapshot_diff", "generic_chunks", "eval_ndcg"]


def canon(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", [*SOME, *(n for n in ORACLE if n not in SOME)])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(canon(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def test_context_of_all_kinds(spark):
    con = duckdb.connect()
    for t in ("nodes", "edges", "shared_nodes"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    all_kinds = entry.oracle_sql()["context_expand"].replace("WHERE kind = 'Function'", "")
    want = set(con.execute(all_kinds).fetchall())
    got = [tuple(r) for r in entry.queries()["context_expand_whole"](spark, DATA).select("hit", "related", "rank").collect()]
    functions = {tuple(r) for r in entry.queries()["context_expand"](spark, DATA).select("hit", "related", "rank").collect()}
    assert len(got) == len(want) and set(got) == want > functions


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
