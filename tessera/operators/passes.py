"""Arrow passes over texts: term counts and hashed vectors text by text.

A text of a few hundred words has about a thousand features. Counting them within
its own row needs no shuffle and no row a feature; words come from the engine's
regular expression, and whatever depends on a word alone is kept for the next one.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words and features whose derivatives one task keeps.
KEPT = 500_000
#: Rows that a pass turns into Python lists at once.
ROWS = 256
_CASE = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})|(?<=[^_])(?=\p{Lu}\p{Ll})", regex.V1)
_CASE_KEEP = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})|(?<=.)(?=\p{Lu}\p{Ll})", regex.V1)


class Kept(dict):
    """Results of a function by argument, forgotten all at once when there are too many."""

    def __init__(self, f) -> None:
        super().__init__()
        self.f = f

    def __missing__(self, x):
        if len(self) >= KEPT:
            self.clear()
        self[x] = out = self.f(x)
        return out


def _cut(rx, word: str) -> list[str]:
    return [p for p in rx.split(word) if p]


def parts_of(word: str) -> tuple[str, tuple[str, ...]]:
    """A word in lower case and the parts of it as an identifier, as ``text.identifier_parts`` has them."""
    pieces = [p for p in word.split("_") if p]
    out = pieces if "_" in word else []
    out = out + [c for p in pieces for c in _cut(_CASE, p)]
    return word.lower(), tuple(dict.fromkeys(p.lower() for p in out))


def term_counts(words: list[str], parts: Kept) -> dict[str, int]:
    """Each word as often as it stands in the text; a part once, if it comes before any such word."""
    count: dict[str, int] = {}
    first: dict[str, int] = {}
    seen: dict[str, int] = {}
    for pos, w in enumerate(words):
        low, ps = parts[w]
        if low in count:
            count[low] += 1
        else:
            count[low], first[low] = 1, pos
        for p in ps:
            if p not in seen:
                seen[p] = pos
    for p, pos in seen.items():
        if p not in count:
            count[p] = 1
        elif pos < first[p]:
            count[p] += 1
    return count


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            piece = b.slice(at, ROWS)
            yield piece, piece.column(piece.num_columns - 1).to_pylist()


def term_rows(docs: DataFrame, id_col: str = "id", text_col: str = "content", only: list[str] | None = None) -> DataFrame:
    """``(id, term, tf, doc_len)`` of texts with unique ids; null and wordless texts give no rows.

    ``only`` keeps the postings of these terms and adds, for each slice, a row
    without id whose ``tf`` and ``doc_len`` are the number and the length of its texts.
    """
    wanted = None if only is None else frozenset(only)
    typ = dict(docs.dtypes)[id_col]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Kept(parts_of)
        for b, rows in _words_of(batches):
            at, terms, tfs, lens, texts, total = [], [], [], [], 0, 0
            for i, ws in enumerate(rows):
                if not ws:
                    continue
                count = term_counts(ws, parts)
                n = sum(count.values())
                texts, total = texts + 1, total + n
                for t in count if wanted is None else wanted.intersection(count):
                    at.append(i)
                    terms.append(t)
                    tfs.append(count[t])
                    lens.append(n)
            ids = b.column(0).take(pa.array(at, pa.int64()))
            out = [ids, pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(lens, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["id", "term", "tf", "doc_len"])
            if wanted is not None and texts:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), pa.nulls(1, pa.string()), pa.array([texts]), pa.array([total])], ["id", "term", "tf", "doc_len"])

    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), T.words(F.col(text_col)).alias("words")).mapInArrow(f, f"id {typ}, term string, tf bigint, doc_len bigint")


class Hasher:
    """Hashed vectors of word lists: words 1, character trigrams 0.5, word pairs 1.5 each time they occur."""

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.tokens = Kept(lambda w: [t.lower() for t in _cut(_CASE_KEEP, w)])
        self.grams = Kept(lambda t: ["c3_" + t[i : i + 3] for i in range(len(t) - 2)])
        self.code = Kept(lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16))

    def counts(self, words: list[str]) -> dict[str, int]:
        """Twice the weight of each feature."""
        tokens: list[str] = []
        for w in words:
            tokens += self.tokens[w]
        each = Counter(tokens)
        out = {t: 2 * c for t, c in each.items()}
        for t, c in each.items():
            for g in self.grams[t]:
                out[g] = out.get(g, 0) + c
        for (a, b), c in Counter(zip(tokens, tokens[1:])).items():
            pair = f"{a}_{b}"
            out[pair] = out.get(pair, 0) + 3 * c
        return out

    def vector(self, words: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
        """The vector of length 1, zero where there is no word, and which of its places a feature fell on."""
        count = self.counts(words or [])
        code = np.fromiter(map(self.code.__getitem__, count), np.int64, len(count))
        w = 1 + np.log(np.fromiter(count.values(), np.float64, len(count)) / 2)
        at = (code >> 1) % self.dim
        v = np.bincount(at, np.where(code % 2 == 0, w, -w), self.dim)
        hit = np.bincount(at, minlength=self.dim) > 0
        n = math.sqrt(float(v @ v))
        return (v / n, hit) if n > 1e-12 else (np.zeros(self.dim), np.zeros(self.dim, bool))


def _matrix(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)


def vector_rows(docs: DataFrame, id_col: str = "id", text_col: str = "content", dim: int = 256, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, vector, hit)`` of texts with unique ids, with the columns ``extra``; a null or wordless text has a zero vector."""
    src = docs.select(F.col(id_col).alias("id"), *extra, T.words(F.col(text_col)).alias("words"))
    schema = ", ".join(f"{n} {t}" for n, t in src.dtypes[:-1]) + ", vector array<double>, hit array<boolean>"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(dim)
        for b, rows in _words_of(batches):
            made = [h.vector(ws) for ws in rows]
            v, hit = np.array([m[0] for m in made]), np.array([m[1] for m in made])
            keep = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, _matrix(v), _matrix(hit)], [*b.schema.names[:-1], "vector", "hit"])

    return src.mapInArrow(f, schema)


def nearest_rows(vectors: DataFrame, ask_ids: list, ask: np.ndarray, ask_hit: np.ndarray | None, limit: int, ask_type: str) -> DataFrame:
    """``(query_id, id, space, distance)``: of each slice of ``vectors(id, space, vector[, hit])`` the nearest to each query and space, ties included.

    With ``hit`` a vector counts only for queries that share a place with it.
    """
    typ = dict(vectors.dtypes)["id"]
    with_hit = ask_hit is not None
    shared = vectors.sparkSession.sparkContext.broadcast((ask_ids, ask, ask_hit.astype(np.float32) if with_hit else None))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, qh = shared.value
        arrow_type = {"int": pa.int32(), "bigint": pa.int64()}.get(ask_type, pa.string())
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                t = b.slice(at, 4096)
                v = matrix_of(t.column(2))
                d = np.round(1 - q @ v.T, 6) + 0.0
                if with_hit:
                    d[qh @ matrix_of(t.column(3)).astype(np.float32).T == 0] = np.inf
                out_q, out_v = [], []
                space = np.array(t.column(1).to_pylist(), object)
                for s in set(space.tolist()):
                    own = np.flatnonzero(space == s)
                    ds = d[:, own]
                    if len(own) > limit:
                        bound = np.partition(ds, limit - 1, axis=1)[:, limit - 1 : limit]
                        ok = (ds <= bound) & np.isfinite(ds)
                    else:
                        ok = np.isfinite(ds)
                    a, c = np.nonzero(ok)
                    out_q.append(a)
                    out_v.append(own[c])
                a, c = np.concatenate(out_q), np.concatenate(out_v)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in a], arrow_type), t.column(0).take(pa.array(c)), t.column(1).take(pa.array(c)), pa.array(d[a, c])], ["query_id", "id", "space", "distance"])

    cols = ["id", "space", "vector"] + (["hit"] if with_hit else [])
    return vectors.select(*cols).mapInArrow(f, f"query_id {ask_type}, id {typ}, space string, distance double")
