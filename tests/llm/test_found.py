import duckdb
import pytest

import __spark_entry__ as entry
from tessera.llm import queries as Q

from ..conftest import DATA
from ..test_queries import TABLES, canon


def test_found_queries_have_the_stated_columns(spark):
    want = {
        "p1_found": ["id_a", "id_b"], "p2_found": ["node_id", "root_id", "depth"], "p3_found": ["vector_id_a", "vector_id_b"], "p4_found": ["file_path"],
        "p5_found": ["id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id_a", "doc_id_b"],
    }
    for name, cols in want.items():
        df = entry.queries()[name](spark, DATA)
        assert df.columns == cols, name
        rows = df.collect()
        assert len(rows) == len({repr(r) for r in rows}) and rows, name


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.execute(Q.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(canon(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
