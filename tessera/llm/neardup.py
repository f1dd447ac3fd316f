"""Near-duplicate records by token-combination prefixes.

A record is the set of its distinct shingles (runs of ``shingle`` words). All
shingles have one global order, rare before frequent. Of each set only a prefix
is indexed: rare shingles one by one, frequent ones as pairs within small fixed
groups, with the prefix extended by one shingle for each group it touches, so
that any two sets of the wanted similarity share a key. Candidates are then
verified on their whole contents.

Why no pair is lost: a set of n shingles can lack at most e = n - ceil(t*n) of
its own in a partner of similarity t. Of the two prefixes take the one that ends
first in the order; each of its shingles that the partner has lies in the
partner's prefix too. It holds c rare shingles and c_g frequent ones of group g
with c + sum(max(0, c_g - 1)) > e, so e losses can't leave it without a common
rare shingle or a common pair in some group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import kernels as K

SHINGLE, MIN_WORDS, THRESHOLD = 3, 30, 0.7
#: Cells of the frequency sketch for each text, and the least and most of them (powers of two).
CELLS_A_TEXT, LEAST_CELLS, MOST_CELLS = 32, 1 << 20, 1 << 26
#: Cells in a block of the sketch, the count from which a cell is frequent beside twice the mean (a key
#: of f sets costs f * (f - 1) / 2 candidates, so a single one is dearer than its sets from 3 on), and
#: groups of frequent shingles.
BLOCK, FREQUENT, GROUPS = 1 << 16, 3, 8
#: Set size up to which plain prefixes are indexed besides: with all shingles frequent, n - GROUPS pairs
#: must outnumber the 0.3 n losses, which fails up to 11, and the partner of such a set has up to 16.
TINY = 18
#: Bits of the filter for the texts of candidates (a power of two).
WANTED = 1 << 23
#: Codes a doubling of a count; small counts have codes of their own.
_CODES = 7


def _sets(batch: pa.RecordBatch, column: str, k: int, min_words: int):
    """Shingles and rows of the texts with enough words."""
    data, off = K.text_bytes(batch.column(batch.schema.get_field_index(column)))
    h, row = K.words(data, off)
    enough = np.bincount(row, minlength=batch.num_rows) >= min_words
    keep = enough[row]
    return K.shingles(h[keep], row[keep], k)


def _fingerprint(s: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash for each set (rows without shingles give one that is not used)."""
    c = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(K.mix(s ^ K.U(0x5851F42D4C957F2D)), out=c[1:])
    return K.mix(c[start + count] - c[start] + count.astype(np.uint64)).view(np.int64)


def _first(fp: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows hold a set that the task has not met yet; ``seen`` grows with the texts of one task."""
    new = np.zeros(len(fp), bool)
    for i, x in enumerate(fp.tolist()):
        if n[i] and x not in seen:
            seen.add(x)
            new[i] = True
    return new


def level_codes(mean: float) -> np.ndarray:
    """Level of each code of a count, where cells hold ``mean`` on average."""
    count = np.round(2 ** (np.arange(256) / _CODES) - 1)
    level = np.minimum(7, np.log2(1 + count / (1 + mean)) * 1.5).astype(np.uint8)
    hot = count >= FREQUENT + 2 * mean
    level[hot] = 8 + np.minimum(200, np.log2(np.maximum(1, count[hot])) * 4).astype(np.uint8)
    return level


def scan_sets(texts: DataFrame, k: int, min_words: int) -> tuple[DataFrame, bytes]:
    """One pass over ``texts(id, content)``: the ids with the fingerprints of their sets, and the sketch.

    The sketch gives the level of every cell: 0-7 rare by counts, 8 and above
    frequent. Counts run over all texts; blocks of the sketch are added up by key
    in the cluster. What reaches the driver is one byte for each cell, a code for
    its count, of at most MOST_CELLS cells (64 MB). Of equal sets a task counts one.
    """
    cells = LEAST_CELLS
    wanted = CELLS_A_TEXT * texts.select("id").count()
    while cells < min(wanted, MOST_CELLS):
        cells *= 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint16)
        names = ["block", "counts", "id", "class_id", "n"]
        id_type = None
        seen: set[int] = set()
        for b in K.slices(batches, "content"):
            s, row = _sets(b, "content", k, min_words)
            start, n = K.starts_of(row, b.num_rows)
            has = np.flatnonzero(n)
            fp = _fingerprint(s, start, n)
            fresh = s[_first(fp, n, seen)[row]]
            cell, times = np.unique((fresh & K.U(cells - 1)).astype(np.int64), return_counts=True)
            total[cell] = np.minimum(total[cell].astype(np.int64) + times, 65535)
            ids = b.column(0).take(pa.array(has))
            id_type = ids.type
            none = len(has)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), ids, pa.array(fp[has]), pa.array(n[has].astype(np.int32))], names
            )
        blocks = [i for i in range(cells // BLOCK) if total[i * BLOCK : (i + 1) * BLOCK].any()]
        if blocks:
            none = len(blocks)
            counts = pa.array([total[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in blocks], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), counts, pa.nulls(none, id_type), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32())], names)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for b in batches:
            for x in b.column(1):
                total += np.frombuffer(x.as_buffer(), np.uint16)
        code = np.minimum(255, np.round(np.log2(1 + total) * _CODES)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([code.tobytes()], pa.binary()), pa.array([int(total.sum())])], ["block", "codes", "total"])

    typ = dict(texts.dtypes)["id"]
    out = materialize(texts.mapInArrow(scan, f"block int, counts binary, id {typ}, class_id bigint, n int"), "sets")
    rows = out.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, codes binary, total bigint").collect()
    codes = np.zeros(cells, np.uint8)
    for r in rows:
        codes[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["codes"], np.uint8)
    level = level_codes(sum(r["total"] for r in rows) / cells)[codes]
    return out.where("block is null").select("id", "class_id", "n").dropDuplicates(["id", "class_id"]), level.tobytes()


def prefix_keys(s: np.ndarray, row: np.ndarray, n_rows: int, level: np.ndarray, t: float):
    """Index keys of sets given as (shingle, row) sorted by row: key, row, set sizes."""
    return _keys(s, row, n_rows, level, t)[:3]


def _keys(s: np.ndarray, row: np.ndarray, n_rows: int, level: np.ndarray, t: float):
    """The same, and how many of the keys, the last ones, are combinations."""
    lv = level[(s & K.U(len(level) - 1)).astype(np.int64)]
    o = np.lexsort((s, lv, row))
    s, row, lv = s[o], row[o], lv[o]
    start, n = K.starts_of(row, n_rows)
    need = (n - np.ceil(t * n - 1e-9).astype(np.int64)) + 1
    pos = np.arange(len(s)) - start[row]
    hot = lv >= 8
    rare = np.bincount(row[~hot], minlength=n_rows)
    single = ~hot & (pos < need[row])
    keys, rows = [K.mix(s[single])], [row[single]]
    tiny = (n[row] <= TINY) & (pos < need[row])
    keys.append(K.mix(s[tiny] ^ K.U(0xA5A5A5A5A5A5A5A5)))
    rows.append(row[tiny])
    f = np.flatnonzero(hot & (rare < need)[row])
    combined = 0
    if len(f):
        fs, fr = s[f], row[f]
        group = (K.mix(fs) >> K.U(40)).astype(np.int64) % GROUPS
        by = np.lexsort((np.arange(len(f)), group, fr))
        g = fr[by] * GROUPS + group[by]
        first = np.ones(len(by), bool)
        first[1:] = g[1:] != g[:-1]
        gain = np.empty(len(f), np.int64)
        gain[by] = ~first
        total = np.cumsum(gain)
        at = np.ones(len(f), bool)
        at[1:] = fr[1:] != fr[:-1]
        base = (total - gain)[np.flatnonzero(at)][np.cumsum(at) - 1]
        take = (total - gain - base) < (need - rare)[fr]
        # pairs of each taken shingle with those taken before it in its group
        kept = by[take[by]]
        g = fr[kept] * GROUPS + group[kept]
        new = np.ones(len(kept), bool)
        new[1:] = g[1:] != g[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(kept) else np.empty(0, np.int64)
        back = np.arange(len(kept)) - head
        left = np.repeat(np.arange(len(kept)), back)
        right = np.repeat(head, back) + (np.arange(len(left)) - np.repeat(np.cumsum(back) - back, back))
        a, b = fs[kept[left]], fs[kept[right]]
        keys.append(K.mix(np.minimum(a, b) * K.U(3) + K.mix(np.maximum(a, b))))
        rows.append(fr[kept[left]])
        combined = len(left)
    return np.concatenate(keys), np.concatenate(rows), n, combined


def class_links(
    texts: DataFrame, id_col: str = "id", column: str = "content", shingle: int = SHINGLE, min_words: int = MIN_WORDS, threshold: float = THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Links between sets and the ids of each set: ``(class_a, class_b, similarity)``, ``(id, class_id, n)``.

    Null ids and texts, empty texts and texts with fewer than ``min_words`` words
    take no part. An id that comes with several contents belongs to several
    classes. Repeated rows count once; other columns are not looked at.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    src = texts.select(F.col(id_col).alias("id"), F.col(column).alias("content")).where("id is not null and content is not null")
    members, levels = scan_sets(src, shingle, min_words)
    level = texts.sparkSession.sparkContext.broadcast(levels)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = np.frombuffer(level.value, np.uint8)
        seen: set[int] = set()
        for b in K.slices(batches, "content"):
            s, row = _sets(b, "content", shingle, min_words)
            start, n = K.starts_of(row, b.num_rows)
            fp = _fingerprint(s, start, n)
            fresh = _first(fp, n, seen)[row]
            s, row = s[fresh], row[fresh]
            if not len(s):
                continue
            key, r, _ = prefix_keys(s, row, b.num_rows, lv, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[r]), pa.array(n[r].astype(np.int32))], ["key", "class_id", "n"])

    # equal sets of different tasks meet under each of their keys and become one there, before the join
    keys = src.select("content").mapInArrow(index, "key bigint, class_id bigint, n int").repartition("key").dropDuplicates(["key", "class_id"])
    a, b = keys.alias("a"), keys.alias("b")
    size = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    pairs = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.class_id") < F.col("b.class_id")) & size)
        .select(F.col("a.class_id").alias("class_a"), F.col("b.class_id").alias("class_b"))
        .distinct()
    )
    pairs = materialize(pairs, "candidates")
    texts_of = materialize(_text_of_class(src.select("content"), pairs, shingle, min_words), "texts")
    both = pairs.join(texts_of.toDF("class_a", "text_a"), "class_a").join(texts_of.toDF("class_b", "text_b"), "class_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, "text_a", 1 << 19):
            n = b.num_rows
            parts = [_sets(b, c, shingle, min_words) for c in ("text_a", "text_b")]
            size_a, size_b = (np.bincount(r, minlength=n) for _, r in parts)
            s = np.concatenate([p[0] for p in parts])
            r = np.concatenate([p[1] for p in parts])
            o = np.lexsort((s, r))
            s, r = s[o], r[o]
            same = (s[1:] == s[:-1]) & (r[1:] == r[:-1])
            common = np.bincount(r[1:][same], minlength=n)
            union = np.maximum(1, size_a + size_b - common)
            ok = np.flatnonzero(common >= threshold * union - 1e-9)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(common[ok] / union[ok])], ["class_a", "class_b", "similarity"]
            )

    return both.mapInArrow(verify, "class_a bigint, class_b bigint, similarity double"), members


def key_report(texts: DataFrame, id_col: str = "id", column: str = "content", shingle: int = SHINGLE, min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row: ``sets`` that are indexed, their ``keys``, those that are ``combinations``, and ``resting`` sets that have such keys.

    Of equal sets each task counts one. Without texts all are null.
    """
    src = texts.select(F.col(id_col).alias("id"), F.col(column).alias("content")).where("id is not null and content is not null")
    level = texts.sparkSession.sparkContext.broadcast(scan_sets(src, shingle, min_words)[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = np.frombuffer(level.value, np.uint8)
        seen: set[int] = set()
        for b in K.slices(batches, "content"):
            s, row = _sets(b, "content", shingle, min_words)
            start, n = K.starts_of(row, b.num_rows)
            fresh = _first(_fingerprint(s, start, n), n, seen)
            if not fresh.any():
                continue
            key, r, _, combined = _keys(s[fresh[row]], row[fresh[row]], b.num_rows, lv, threshold)
            got = (int(fresh.sum()), len(key), combined, len(np.unique(r[len(r) - combined :])))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got], ["sets", "keys", "combinations", "resting"])

    rows = src.select("content").mapInArrow(count, "sets bigint, keys bigint, combinations bigint, resting bigint")
    return rows.agg(*(F.sum(c).alias(c) for c in ("sets", "keys", "combinations", "resting")))


def _text_of_class(contents: DataFrame, pairs: DataFrame, shingle: int, min_words: int) -> DataFrame:
    """``(class_id, content)``: one content of each class in ``pairs``.

    The classes go ahead as a bitmap of WANTED bits, so that a scan drops nearly
    all other contents before any shuffle; a semi join drops the rest.
    """
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    bit = F.pmod(F.col("class_id"), F.lit(WANTED)) + 1
    bits = ends.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    flat = bytearray(WANTED // 8)
    for r in bits:
        at = (r["bucket"] - 1) * 4096
        flat[at : at + 4096] = r["bits"]
    wanted = contents.sparkSession.sparkContext.broadcast(bytes(flat))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(wanted.value, np.uint8)
        for b in K.slices(batches, "content"):
            s, row = _sets(b, "content", shingle, min_words)
            start, n = K.starts_of(row, b.num_rows)
            fp = _fingerprint(s, start, n)
            at = fp & (WANTED - 1)
            ok = np.flatnonzero((n > 0) & ((mask[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))
            yield pa.RecordBatch.from_arrays([pa.array(fp[ok]), b.column(0).take(pa.array(ok))], ["class_id", "content"])

    return contents.mapInArrow(f, "class_id bigint, content string").dropDuplicates(["class_id"]).join(ends, "class_id", "left_semi").select("class_id", "content")


def near_duplicate_pairs(texts: DataFrame, id_col: str = "id", column: str = "content", **how) -> DataFrame:
    """``(id_a, id_b, similarity)``, ``id_a < id_b``: every pair of different ids of similar contents, copies included."""
    links, members = class_links(texts, id_col, column, **how)
    m = members.select("id", "class_id")
    far = links.join(m.toDF("x", "class_a"), "class_a").join(m.toDF("y", "class_b"), "class_b").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    several = m.groupBy("class_id").agg(F.count("*").alias("c")).where("c > 1").select("class_id")
    own = m.join(several, "class_id", "left_semi").select("id", "class_id")
    near = own.toDF("id_a", "class_id").join(own.toDF("id_b", "class_id"), "class_id").where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    return far.unionByName(near).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def near_duplicate_summary(texts: DataFrame, id_col: str = "id", column: str = "content", smallest: bool = False, **how) -> DataFrame:
    """``(id, class_id, n, copies, links)``: one row for each id and class; copies stay together, links are other classes.

    A class goes by the hash of its set, with ``smallest`` by its smallest id.
    """
    links, members = class_links(texts, id_col, column, **how)
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    per = members.groupBy("class_id").agg(F.count("*").alias("copies"), F.min("id").alias("low")).join(degree, "class_id", "left")
    name = F.col("low") if smallest else F.col("class_id")
    return members.join(per, "class_id").select("id", name.alias("class_id"), "n", "copies", F.coalesce("links", F.lit(0)).alias("links"))
