import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import encode as E
from tessera.llm import pack as P
from tessera.llm import split as S

TOKEN = re.compile(r"[^ \t\r\n]+")


def check_pieces(text, tokens=320, chars=4000):
    parts = S.split_text(text, tokens, chars)
    assert "".join(text[s:e] for s, e, _ in parts) == text
    for k, (s, e, o) in enumerate(parts):
        own = text[s - o : e]
        assert len(own) <= chars and len(TOKEN.findall(own)) <= tokens
        if k:
            before = text[parts[k - 1][0] : s]
            last = before.rstrip(" \t\r\n")
            line = before[last.rfind("\n") + 1 :]
            if len(line) <= 400 and len(TOKEN.findall(line)) <= 32:
                assert o == len(line)
            else:
                assert 0 < o <= 400 and len(TOKEN.findall(text[s - o : s])) <= 32
        else:
            assert o == 0
    return parts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "\n", "\r\n", "\n\n", "    x = 1\n", "# Head\n", "```\n", "- item\n", "é漢 ", "a" * 300, "}\n", "\t"]), max_size=1500))
def test_any_text_is_cut_within_the_limits(parts):
    check_pieces("".join(parts))


def test_cuts_fall_on_headings_first():
    text = "".join(f"# H{i}\n\n" + "word " * 150 + "\n\n" + "more " * 100 + "\n\n" for i in range(4))
    starts = [text[s : s + 3] for s, _, _ in check_pieces(text)]
    assert starts == ["# H0"[:3], "# H", "# H", "# H"]


def test_one_long_line():
    assert len(check_pieces("x" * 33_000)) >= 9
    check_pieces("key=value;" * 3000)


def test_split_table(spark):
    big = "\n".join(f"line {i} of a text" for i in range(200))
    rows = [("a", big, 11, "z"), ("a", big, 11, "z"), ("b", big, None, "z"), ("c", None, 1, "z"), ("d", "small", 1, "z"), (None, big, 1, "z"), ("e", " ".join(["t"] * 320), 1, "z"), ("f", " ".join(["t"] * 321), 1, "z"), ("g", "y" * 4000, 1, "z"), ("h", "y" * 4001, 1, "z")]
    got = S.split_oversized(spark.createDataFrame(rows, "id string, content string, start_line int, piece string")).collect()
    assert {r["id"] for r in got} == {"a", "b", "f", "h"}
    a = sorted((r for r in got if r["id"] == "a"), key=lambda r: r["piece"])
    assert a[0]["start_line"] == 11 and a[-1]["end_line"] == 210 and all(y["start_line"] == x["end_line"] for x, y in zip(a, a[1:]))
    assert all(r["tokens_approx"] == len(TOKEN.findall(r["content"])) for r in got)
    assert min(r["start_line"] for r in got if r["id"] == "b") == 1
    assert S.split_oversized(spark.createDataFrame([], "id string, content string, start_line int")).collect() == []


def test_encoding_round_trip(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_CHARS", 400)
    rnd = random.Random(2)
    texts = [None, "", "   \n\n  x", "<|endoftext|> it's we'll  ", "é é 漢字 😀‍👩 ​ 　 end", "a" * 5000, "don't\r\n\tstop 12345"] + ["".join(rnd.choice(["foo ", "bar", "\n", " ", "ß", "9", "'s"]) for _ in range(rnd.randint(0, 200))) for _ in range(40)]
    rows = [(i, t, 1, "b") for i, t in enumerate(texts)] + [(None, "x", 1, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, code int, block string")
    enc = E._encoding("byte_bpe_50k", E.TOKENIZER_DIR)
    got = {r["doc_id"]: list(r["ids"]) for r in E.encode_corpus(df).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in E.decode_corpus(E.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_encoding_of_repeated_ids_strings_and_nothing(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a"), ("n", None)], "doc_id string, text string")
    enc = E._encoding("byte_bpe_50k", E.TOKENIZER_DIR)
    assert {r["doc_id"]: list(r["ids"]) for r in E.encode_corpus(df).collect()} == {"k": enc.encode_ordinary("a"), "n": []}
    assert E.encode_corpus(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plans_pack_exactly(seed):
    rnd = random.Random(seed)
    hist = {rnd.randint(1, 90 if seed % 2 else 200): rnd.randint(1, 500) for _ in range(80)}
    plan = P.plan(hist, 200)
    used = {}
    for config, copies in plan:
        assert sum(s * n for s, n in config.items()) <= 200
        for s, n in config.items():
            used[s] = used.get(s, 0) + n * copies
    assert used == hist
    boxes, least = sum(c for _, c in plan), -(-sum(s * n for s, n in hist.items()) // 200)
    assert boxes <= sum(c for _, c in P._best_fit(Counter(hist), 200))
    if seed % 2:
        assert boxes <= 1.005 * least + 3


def test_plan_where_greedy_wastes():
    hist = {36: 2000, 33: 1500, 31: 1500, 17: 3000}
    assert sum(c for _, c in P.plan(hist, 100)) <= 0.97 * sum(c for _, c in P._best_fit(Counter(hist), 100))


@pytest.mark.parametrize("hist, capacity, optimum", [({51: 600, 27: 600, 26: 600, 23: 1200}, 100, 900), ({60: 100, 50: 333}, 100, 266.5), ({40: 1000}, 100, 500), ({7: 3}, 7, 3)])
def test_program_is_covered_and_near_its_optimum(hist, capacity, optimum):
    x = P.fractional(hist, capacity)
    covered = Counter()
    for config, w in x.weights:
        assert w > 0 and sum(s * n for s, n in config.items()) <= capacity
        for s, n in config.items():
            covered[s] += n * w
    assert all(abs(covered[s] - n) <= 1e-6 * n for s, n in hist.items()) and set(covered) == set(hist)
    assert x.bound - 1e-6 <= optimum <= x.objective + 1e-6 and x.objective <= 1.01 * optimum
    assert x.by_weights >= 0.9 * x.objective


@pytest.mark.parametrize("seed", range(3))
def test_program_over_many_sizes_is_near_its_bound(seed):
    rnd = random.Random(seed)
    hist = Counter(min(2047, 1 + int(rnd.expovariate(1 / 350))) for _ in range(9000))
    x = P.fractional(hist, 2048)
    assert x.objective <= 1.02 * x.bound and x.by_weights >= 0.9 * x.objective
    assert sum(c for _, c in P.plan(hist, 2048)) <= 1.001 * x.bound + 2


def test_the_program_beats_best_fit():
    hist = {51: 600, 27: 600, 26: 600, 23: 1200}
    assert sum(c for _, c in P._best_fit(Counter(hist), 100)) >= 1.05 * 900
    assert sum(c for _, c in P.plan(hist, 100)) <= 902


def test_pack_table(spark, monkeypatch):
    monkeypatch.setattr(P, "RANK_ROWS", 10)
    rnd = random.Random(6)
    rows = [(i, rnd.choice([7, 7, 7, 300, 2048, rnd.randint(1, 6000)]), "x") for i in range(300)] + [(900, None, "x"), (901, 0, "x"), (902, -3, "x"), (None, 5, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, container string")
    got = P.pack(df).collect()
    boxes, items = {}, {}
    for r in got:
        boxes[r["container"]] = boxes.get(r["container"], 0) + r["size"]
        items.setdefault(r["doc_id"], []).append(r)
    assert max(boxes.values()) <= 2048 and sorted(boxes) == list(range(len(boxes)))
    for i, n, _ in rows:
        if i is None:
            continue
        parts = sorted(items[i], key=lambda r: r["piece"])
        assert sum(r["size"] for r in parts) == max(0, n or 0)
        assert [r["start"] for r in parts] == [2048 * k for k in range(len(parts))] and (len(parts) == 1 or n > 2048)
    rep = P.fill_report(P.pack(df)).first()
    assert rep["containers"] <= rep["least"] + 2
    assert P.pack(df.limit(0)).collect() == []
    own = df.where("doc_id is not null")
    row = P.misfits(P.pack(own), own).first()
    assert tuple(row) == (303, 300, 0, 0, 0, 0, True)
    assert tuple(P.misfits(P.pack(own.limit(0)), own.limit(0)).first()) == (0, 0, 0, 0, 0, 0, True)
    assert P.program_report(own.limit(0)).first()["configurations"] == 0


def test_misfits_of_pieces(spark):
    big = "\n".join(f"line {i} of a text" for i in range(200))
    df = spark.createDataFrame([("a", big, 11), ("b", "y" * 9000, None), ("c", "small", 1)], "id string, content string, start_line int")
    cut = S.split_oversized(df)
    from pyspark.sql import functions as F

    def wrong(c):
        rows = S.misfits(c, df).collect()
        return len(rows), *(sum(r[n] for r in rows) for n in ("too_large", "miscounted", "wrong_overlap", "not_whole", "wrong_lines"))

    assert wrong(cut) == (2, 0, 0, 0, 0, 0)
    assert wrong(cut.where("not (id = 'a' and piece = 1)"))[4] == 1
    assert wrong(cut.withColumn("tokens_approx", F.col("tokens_approx") + 1))[2] > 0
    assert wrong(cut.withColumn("end_line", F.col("end_line") + 1))[5] > 0
    assert wrong(cut.withColumn("overlap_chars", F.lit(0)))[3] > 0
    assert S.misfits(cut.limit(0), df).collect() == []
