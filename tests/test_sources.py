import os
import random

from tessera.api import Engine
from tessera.plans import table_queries
from tessera.sources import files, parsers

from .conftest import DATA


def test_rust_python_script_symbols():
    rs = parsers.rust_symbols(["/// Doc", "pub fn a() {", "}", "impl T for S {", " fn m(&self) {", " }", "}", "pub struct P { x: u8 }", "impl E {", "}"])
    assert [(f.name, f.kind, f.start, f.end) for f in rs] == [("a", "Function", 2, 3), ("impl_T_for_S", "Trait", 4, 7), ("S::m", "Method", 5, 6), ("P", "Struct", 8, 8), ("impl_E", "Struct", 9, 10)]
    assert rs[0].doc == "Doc" and rs[2].bases == ["T::m"]
    py = parsers.python_symbols(["class A(B, object):", "    def m(self):", "        pass", "", "async def f(x):", "    return 1"])
    assert [(f.name, f.kind, f.start, f.end, f.bases) for f in py] == [("A", "Class", 1, 4, ["B"]), ("f", "Function", 5, 6, [])]
    js = parsers.script_symbols(["export function f() {", "}", "const g = async (x) => {", "}", "class A extends B implements C, D {", "}", "interface I {", "}"])
    assert [(f.name, f.kind) for f in js] == [("f", "Function"), ("g", "Function"), ("A", "Class"), ("I", "Interface")] and js[2].bases == ["B", "C", "D"]


def test_windows():
    assert [(f.start, f.end) for f in parsers.windows(["x"] * 101)] == [(1, 50), (41, 90), (81, 101)]
    assert [(f.start, f.end) for f in parsers.windows(["x"] * 50)] == [(1, 50)] and parsers.windows([]) == []


def test_markdown_sections():
    text = "# One\nsee [x](#two) `[n](#two)` ![i](#two) \\[e](#two)\n```\n# no\n~~~\n[c](#two)\n```\n## Two\nt\n## Two\n"
    s = parsers.markdown_sections(text)
    assert [(x.title, x.start, x.end, x.anchor) for x in s] == [("One", 1, 7, "one"), ("Two", 8, 9, "two"), ("Two", 10, 10, "two-1")]
    assert s[0].links == [(2, "two")]


def test_sections_and_anchors_of_all_documents(spark, tmp_path):
    texts = [
        "intro\n# One\n```\n# no\n~~~\n## no\n```\n## Two\r\nt\n## Two\n",
        "~~~ x\n# no\n```\n~~~\n# Überblick\n# Überblick\n#none\n# 記値 検索\n```\n# open to the end",
        "# Plain\nt\n# Plain\n# Other", "", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda df: {tuple(r) for r in df.collect()}
    got = rows(table_queries.md_sections_whole(spark, str(tmp_path)).select("doc_id", "section", "start_line", "end_line", "lines"))
    assert got == {(0, 0, 1, 1, 1), (0, 1, 2, 7, 6), (0, 2, 8, 9, 2), (0, 3, 10, 10, 1), (1, 0, 1, 4, 4), (1, 1, 5, 5, 1), (1, 2, 6, 7, 2), (1, 3, 8, 10, 3), (2, 1, 1, 2, 2), (2, 2, 3, 3, 1), (2, 3, 4, 4, 1), (3, 0, 1, 1, 1)}
    got = rows(table_queries.anchor_ordinals_whole(spark, str(tmp_path)).select("doc_id", "line", "slug", "ordinal"))
    assert got == {(0, 2, "one", 0), (0, 8, "two", 0), (0, 10, "two", 1), (1, 5, "überblick", 0), (1, 6, "überblick", 1), (1, 8, "記値-検索", 0), (2, 1, "plain", 0), (2, 3, "plain", 1), (2, 4, "other", 0)}


def test_whole_sections_hold_those_of_documents_without_fences(spark):
    for name in ("md_sections", "anchor_ordinals"):
        a, b = (getattr(table_queries, n)(spark, DATA) for n in (name, name + "_whole"))
        assert a.count() and not a.select(b.columns).exceptAll(b).count()


def test_pdf_literals():
    pdf = b"%PDF-1.4\nstream\nBT (Visible heading) Tj ET\nBT [(Split) -20 ( para\\(graph)] TJ (hid) ET (x) Tj\nendstream"
    assert parsers.pdf_sections(pdf) == ["Visible heading Split para(graph"]


def test_call_candidates(spark):
    c = spark.createDataFrame([("n1", "helper(1); foo (2)"), ("n2", "fn helper() {}"), ("n3", None)], "node_id string, content string")
    f = spark.createDataFrame([("f1", "helper"), ("f2", "helper"), ("n1", "helper"), ("f3", "foo")], "id string, label string")
    assert {tuple(r) for r in parsers.call_candidates(c, f).collect()} == {("n1", "f1"), ("n1", "f2")}


def write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_scan_keeps_text_alone(spark, tmp_path):
    root = str(tmp_path / "r")
    for p, t in {"notes.md": "# T\nx", "p.png": b"\x89PNG", "nul.txt": b"a\0b", "d.docx": "x", "fake.pdf": "no", "real.pdf": b"%PDF-1\nstream BT (Hello there) Tj ET endstream", "blank.txt": " \n", ".git/x.md": "x", "build/y.md": "y", "bad.txt": b"\xff\xfe"}.items():
        write(root, p, t)
    assert {r["path"] for r in files.scan(spark, root).collect()} == {"notes.md", "real.pdf"}


def test_git_log(spark):
    log = ["COMMIT:a1|first | x", "f1", "f2", "", "COMMIT:b2|empty", "COMMIT:c3|last", "f1"]
    got = files.parse_git_log(spark.createDataFrame(list(enumerate(log)), "line_no int, line string")).orderBy("seq").collect()
    assert [(r["hash"], r["subject"], r["files"]) for r in got] == [("a1", "first | x", ["f1", "f2"]), ("c3", "last", ["f1"])]


def test_chunk_ends_move_to_nodes(spark):
    c = spark.createDataFrame([("c1", "f", 1, 2, "n1"), ("c2", "f", 3, 4, None)], "id string, file_path string, start_line int, end_line int, node_id string")
    n = spark.createDataFrame([("n1", "x", "Function", "f")], "id string, label string, kind string, file_path string")
    e = spark.createDataFrame([("c1", "c2", "NextChunk"), ("n1", "zz", "Calls")], "source string, target string, kind string")
    nodes, edges = parsers.normalize_chunk_edges(c, n, e)
    assert {(r["id"], r["kind"]) for r in nodes.collect()} == {("n1", "Function"), ("c2", "Chunk")}
    assert {(r["source"], r["target"]) for r in edges.collect()} == {("n1", "c2"), ("n1", "zz")}


def test_refresh_equals_a_fresh_run(spark, tmp_path):
    """Seeded creations, edits, deletions, moves and copies over six paths."""
    root = str(tmp_path / "r")
    rnd = random.Random(3)
    paths = [f"m{i}.{'md' if i % 3 == 0 else 'py'}" for i in range(6)]
    made = 0

    def text(path):
        nonlocal made
        made += 1
        return f"# Head {made}\n[x](#two)\n## Two\nword{made}\n" if path.endswith("md") else f"def name_{made}(x):\n    return name_{rnd.randint(1, made)}(x)\n"

    for p in paths[:3]:
        write(root, p, text(p))
    e = Engine(str(tmp_path / "db"), spark)
    e.index(root)
    for _ in range(3):
        for _ in range(4):
            have = sorted(os.listdir(root))
            p, other = rnd.choice(paths), rnd.choice(paths)
            op = rnd.choice(["edit", "edit", "delete", "move", "copy"])
            full = os.path.join(root, p)
            if op == "edit" or p not in have:
                write(root, p, text(p))
            elif op == "delete":
                os.remove(full)
            elif op == "move" and p != other:
                os.replace(full, os.path.join(root, other))
            elif op == "copy" and p != other:
                write(root, other, open(full).read())
        e.refresh(root)
    fresh = Engine(str(tmp_path / "db2"), spark)
    fresh.index(root)
    for t in ("chunks", "nodes", "edges", "postings", "features", "lengths"):
        rows = lambda x: sorted(map(repr, x.tables[t].collect()))  # noqa: E731, B023
        assert rows(e) == rows(fresh), t
    again = Engine(str(tmp_path / "db"), spark)
    assert again.stats() == e.stats()


def test_absent_folder_is_empty(spark, tmp_path):
    assert Engine(str(tmp_path / "none"), spark).stats() == {"chunks": 0, "nodes": 0, "edges": 0}
