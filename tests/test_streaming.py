import random
from datetime import datetime, timedelta

from tessera.streaming import watch


def test_debounce_is_a_fixed_delay(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(milliseconds=m)) for i, m in enumerate([0, 200, 299, 301, 600, 602, 5000])]
    got = watch.debounce(spark.createDataFrame(rows, "id int, ts timestamp"), "ts", None, 300).collect()
    starts = {}
    for r in got:
        starts.setdefault(r["batch_start"], []).append(r["id"])
    assert sorted(map(sorted, starts.values())) == [[0, 1, 2], [3, 4], [5], [6]]


def test_batches_go_on_over_midnight(spark):
    rnd, t0 = random.Random(6), datetime(2024, 1, 1)
    secs = {k: sorted(rnd.choice([rnd.randrange(4 * 86400), 86400 + rnd.randrange(-900, 900), 3 * 86400 + rnd.randrange(-900, 900)]) for _ in range(400)) for k in "ab"}
    want = set()
    for k, xs in secs.items():
        start = None
        for x in xs:
            start = x if start is None or x - start > 300 else start
            want.add((k, t0 + timedelta(seconds=x), t0 + timedelta(seconds=start)))
    rows = [(k, t0 + timedelta(seconds=x)) for k, xs in secs.items() for x in xs]
    got = watch.debounce(spark.createDataFrame(rows, "k string, ts timestamp"), "ts", "k", 300_000).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_upsert_stream(spark, tmp_path):
    src = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, seq int, v string")
    src.write.parquet(str(tmp_path / "in"))
    state = {"df": spark.createDataFrame([(2, 0, "old"), (3, 0, "keep")], "k int, seq int, v string")}
    q = watch.upsert_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), lambda: state["df"], lambda df: state.update(df=spark.createDataFrame(df.collect(), df.schema)), "k", "seq", str(tmp_path / "log"))
    q.awaitTermination()
    assert {tuple(r) for r in state["df"].collect()} == {(1, 2, "b"), (2, 1, "c"), (3, 0, "keep")}
