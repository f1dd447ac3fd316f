"""Long exact spans shared between records, by suffix automata of reference shards.

1. Each text gives anchors: of every run of ``min_chars`` characters the smallest
   hash of ANCHOR characters in it. Two texts with such a run in common choose
   the same anchor in it, so no common span is without a shared anchor.
2. Only stretches of text around anchors that several texts have go on. Each
   text has a home shard (by the smallest of its shared anchors, split by size);
   its stretches are that shard's reference, and they are also streamed against
   every other shard that holds a text with one of its anchors.
3. A task builds the suffix automaton of a shard's reference stretches, with the
   set of texts of each state, and runs the streamed stretches through it. The
   matching statistics give the spans and whom they are shared with, exactly.

Characters are Unicode code points. Equal texts are handled once, under the hash
of the text, and given back to all their records at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import kernels as K

MIN_CHARS = 150
#: Characters an anchor hashes; characters of differing and of all reference text in a shard, and of
#: streamed text in a task.
ANCHOR, SHARD_CHARS, MOST_SHARD_CHARS, STREAM_CHARS = 100, 60_000, 400_000, 400_000
#: Groups of a task on average, and most tasks of the automata.
GROUPS_A_TASK, MOST_TASKS = 2, 50_000
#: Texts of an anchor from which spans are counted and not matched text by text.
CROWD = 500
_LOW = (1 << 24) - 1
#: Bits for the length of a run of places.
_RUN = 31
_SEGMENT = 1 << 19


def anchors(text: np.ndarray, min_chars: int = MIN_CHARS, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the anchors of one text of code points.

    Of equal smallest hashes the rightmost counts. Long texts go in segments
    that overlap by ``min_chars - 1``, so each run lies in one of them.
    """
    w = min_chars - k + 1
    got_h, got_p = [], []
    step = _SEGMENT
    for at in range(0, max(1, len(text) - min_chars + 1), step):
        part = text[at : at + step + min_chars - 1]
        n = len(part)
        if n < min_chars:
            continue
        p, inv = K.powers(n + 1)
        c = np.zeros(n + 1, np.uint64)
        v = part.astype(np.uint64) * K.U(0xD6E8FEB86659FD93)
        v ^= v >> K.U(32)
        np.cumsum(v * p[:-1], out=c[1:])
        h = K.mix((c[k:] - c[:-k]) * inv[: n - k + 1])
        pos = np.arange(len(h), dtype=np.uint64)
        low = (h & ~K.U(_LOW)) | (K.U(_LOW) - pos)
        span = 1
        while span * 2 <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        where = (K.U(_LOW) - (low & K.U(_LOW))).astype(np.int64)
        where = np.unique(where)
        got_h.append(h[where])
        got_p.append(where + at)
    if not got_h:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, p = np.concatenate(got_h), np.concatenate(got_p)
    p, first = np.unique(p, return_index=True)
    return h[first], p


def _anchor_runs(min_chars: int, k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in K.slices(batches, "text", 1 << 22):
            out = []
            for fp, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(t) < min_chars or fp in seen:
                    continue
                seen.add(fp)
                h, p = anchors(K.code_points(t), min_chars, k)
                # neighbours of one hash (runs of one character) make one row
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1] + 1)
                s = np.flatnonzero(new)
                e = np.append(s[1:], len(h)) - 1
                # first place and length of the run in one number, as these rows are what is shuffled
                out.append((h[s].view(np.int64), np.full(len(s), fp), p[s] << _RUN | (p[e] - p[s])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["anchor", "fp", "run"])

    return f


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each text that a task meets."""
    seen: set[int] = set()
    for b in batches:
        keep = []
        for i, fp in enumerate(b.column(0).to_pylist()):
            if fp not in seen:
                seen.add(fp)
                keep.append(i)
        yield b if len(keep) == b.num_rows else b.take(pa.array(keep, pa.int64()))


class Automaton:
    """Suffix automaton of several texts, with a bit set of texts for each long state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.texts = [-1], [0], [0]

    def add(self, text: str, owner: int) -> None:
        """Add one text; ``owner`` is its bit."""
        nxt, link, length, texts = self.next, self.link, self.length, self.texts
        last = 0
        for ch in text:
            q = nxt[last].get(ch)
            if q is not None and length[q] == length[last] + 1:
                cur = q
            elif q is not None:
                cur = self._clone(q, last, ch)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                texts.append(0)
                p = last
                while p >= 0 and ch not in nxt[p]:
                    nxt[p][ch] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][ch]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(q, p, ch)
            texts[cur] |= owner
            last = cur

    def _clone(self, q: int, p: int, ch: str) -> int:
        nxt, link = self.next, self.link
        c = len(nxt)
        nxt.append(nxt[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.texts.append(0)
        while p >= 0 and nxt[p].get(ch) == q:
            nxt[p][ch] = c
            p = link[p]
        link[q] = c
        return c

    def finish(self, least: int) -> None:
        """Hand the owners of each state of ``least`` characters or more down to its suffixes of as many."""
        length, link, texts = self.length, self.link, self.texts
        long = [i for i in range(len(length)) if length[i] >= least]
        for i in sorted(long, key=length.__getitem__, reverse=True):
            texts[link[i]] |= texts[i]

    def matches(self, text: str, least: int) -> Iterator[tuple[int, int]]:
        """``(end, owners)`` for each position at which ``least`` characters end that the automaton has."""
        nxt, link, length, texts = self.next, self.link, self.length, self.texts
        v = have = 0
        for i, ch in enumerate(text):
            while v and ch not in nxt[v]:
                v = link[v]
                have = length[v]
            to = nxt[v].get(ch)
            if to is None:
                have = 0
                continue
            v = to
            have += 1
            if have >= least:
                while length[link[v]] >= least:
                    v = link[v]
                    have = length[v]
                yield i + 1, texts[v]


def _match(min_chars: int, pairs: bool):
    """One task: the automaton of a shard's reference stretches, and the streamed ones against it.

    Gives either pairs, each in the order of hashes and so from one side alone, or spans.
    """

    def f(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).select(["is_ref", "fp", "at", "stretch"]).to_pydict()
        rows = sorted(zip(*t.values()))
        auto, bit, names = Automaton(), {}, []
        for ref, fp, _, text in rows:
            if ref:
                if fp not in bit:
                    bit[fp] = 1 << len(names)
                    names.append(fp)
                auto.add(text, bit[fp])
        auto.finish(min_chars)
        out: list[list] = [[], [], []]
        seen: dict[int, int] = {}
        for ref, fp, at, text in rows:
            if ref:
                continue
            own = bit.get(fp, 0)
            start = end = -1
            for stop, who in auto.matches(text, min_chars):
                who &= ~own
                if not who:
                    continue
                if pairs:
                    seen[fp] = seen.get(fp, 0) | who
                    continue
                if stop - min_chars > end:
                    if end >= 0:
                        out[0].append(fp), out[1].append(at + start), out[2].append(at + end)
                    start = stop - min_chars
                end = stop
            if end >= 0:
                out[0].append(fp), out[1].append(at + start), out[2].append(at + end)
        if not pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["fp", "start", "end"])
            return
        all_names = np.array(names, np.int64)
        for fp, who in seen.items():
            bits = np.unpackbits(np.frombuffer(who.to_bytes((len(names) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(names)]
            others = all_names[bits.astype(bool)]
            others = others[others > fp]
            if len(others):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), fp, np.int64)), pa.array(others)], ["fp", "other"])

    return f


def _window_hashes(text: np.ndarray, min_chars: int) -> np.ndarray:
    """A hash of each run of ``min_chars`` characters."""
    p, inv = K.powers(len(text) + 1)
    c = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(K.mix(text.astype(np.uint64) + K.U(1)) * p[:-1], out=c[1:])
    n = len(text) - min_chars + 1
    return K.mix((c[min_chars:] - c[:-min_chars]) * inv[:n])


def _crowded(src: DataFrame, shared: DataFrame, min_chars: int, k: int) -> DataFrame:
    """Spans ``(fp, start, end)`` around anchors of very many texts, by counting the runs that hold them.

    Against each other these texts would cost the square of their number. A run
    that two of them share has its anchor in common, so it is counted for both: a
    run's hash, with the anchor's, counts in each task first, and what comes from
    several texts goes back to the texts that hold it.
    """
    spots = shared.groupBy("fp").agg(F.collect_list(F.struct("anchor", "p0", "p1")).alias("spots"))
    texts = spots.join(src.mapInArrow(_once, "fp bigint, text string"), "fp").select("fp", "spots", "text").dropDuplicates(["fp"])
    margin = min_chars - k

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, "text", 1 << 21):
            out: list[list] = [[], [], [], []]
            for fp, at, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                h = _window_hashes(K.code_points(text), min_chars)
                for s in at:
                    a, z = max(0, s["p0"] - margin), min(len(h), s["p1"] + 1)
                    if z > a:
                        own = h[a:z]
                        out[0].append(np.full(len(own), fp))
                        out[1].append(np.arange(a, z))
                        out[2].append(np.full(len(own), s["anchor"]))
                        out[3].append(own.view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["fp", "at", "anchor", "run"])

    runs = materialize(texts.mapInArrow(cut, "fp bigint, at bigint, anchor bigint, run bigint"), "runs")
    several = runs.groupBy("anchor", "run").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("anchor", "run")
    hit = runs.join(several, ["anchor", "run"], "left_semi").select("fp", "at").distinct()
    # runs at neighbouring places make one span
    w = Window.partitionBy("fp").orderBy("at")
    first = hit.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(w) > min_chars).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(w))
    return first.groupBy("fp", "g").agg(F.min("at").alias("start"), (F.max("at") + min_chars).alias("end")).select("fp", "start", "end")


def _matched(docs: DataFrame, min_chars: int, k: int, pairs: bool) -> DataFrame:
    """By hash of text either ``(fp, other)``, ``fp < other``, or the spans ``(fp, start, end)``.

    Pairs of texts are listed whole, so each meets each that shares an anchor. For
    spans an anchor of more than CROWD texts is counted instead.
    """
    src = docs.select(F.xxhash64("text").alias("fp"), "text").where(F.length("text") >= min_chars)
    found = src.mapInArrow(_anchor_runs(min_chars, k), "anchor bigint, fp bigint, run bigint")
    # an anchor of several texts; copies of a text count once
    several = found.groupBy("anchor").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("anchor")
    p0 = F.shiftright("run", _RUN)
    both = found.join(several, "anchor").select("fp", "anchor", p0.alias("p0"), (p0 + F.col("run").bitwiseAND(F.lit((1 << _RUN) - 1))).alias("p1"))
    shared = materialize(both.groupBy("fp", "anchor", "p0").agg(F.max("p1").alias("p1")), "anchors")
    if pairs:
        return _automata(src, shared, min_chars, k, True)
    # at most as many as places of anchors / CROWD
    crowd = materialize(shared.groupBy("anchor").agg(F.approx_count_distinct("fp").alias("m")).where(F.col("m") > CROWD).select("anchor"), "crowd")
    if crowd.isEmpty():
        return _automata(src, shared, min_chars, k, False)
    few = materialize(shared.join(crowd, "anchor", "left_anti"), "few")
    return _automata(src, few, min_chars, k, False).unionByName(_crowded(src, shared.join(crowd, "anchor", "left_semi"), min_chars, k))


def _automata(src: DataFrame, shared: DataFrame, min_chars: int, k: int, pairs: bool) -> DataFrame:
    """The same for the texts ``(fp, text)`` and their anchors ``(fp, anchor, p0, p1)``, by shards."""
    runs = shared.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("p0", "p1"))).alias("runs"), F.min("anchor").alias("home"))
    margin = min_chars - k

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, "text", 1 << 22):
            out: list[list] = [[], [], [], []]
            for fp, home, spots, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                s = e = -1
                stretches = []
                for r in spots:
                    a, z = max(0, r["p0"] - margin), min(len(text), r["p1"] + k + margin)
                    if e >= 0 and a <= e:
                        e = max(e, z)
                        continue
                    if e >= 0:
                        stretches.append((s, e))
                    s, e = a, z
                stretches.append((s, e))
                for s, e in stretches:
                    if e - s >= min_chars:
                        for col, x in zip(out, (fp, home, s, text[s:e])):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["fp", "home", "at", "stretch"])

    # copies leave a task once, so a text of many records is no hot key
    texts = runs.join(src.mapInArrow(_once, "fp bigint, text string"), "fp").select("fp", "home", "runs", "text").dropDuplicates(["fp"])
    stretches = materialize(texts.mapInArrow(cut, "fp bigint, home bigint, at bigint, stretch string"), "stretches")
    # shards of bounded text: homes are put together in buckets, buckets that grew too large are split by text
    total = stretches.agg(F.sum(F.length("stretch"))).first()[0] or 0
    buckets = max(1, -(-total // SHARD_CHARS))
    chars = F.length("stretch")
    sized = stretches.groupBy("fp", "home", F.pmod("home", F.lit(buckets)).alias("bucket")).agg(F.sum(chars).alias("chars"))
    # texts of one home repeat each other but for the margins, and repeated text adds no states
    homes = sized.groupBy("bucket", "home").agg(F.sum("chars").alias("c"), F.count("*").alias("m"))
    fresh = F.least(F.col("c"), F.col("c") / F.col("m") + F.col("m") * (2 * margin))
    split = homes.groupBy("bucket").agg(F.greatest(F.ceil(F.sum(fresh) / SHARD_CHARS), F.ceil(F.sum("c") / MOST_SHARD_CHARS)).cast("int").alias("parts"))
    home = materialize(
        sized.join(split, "bucket").select("fp", "chars", F.xxhash64("bucket", F.pmod(F.xxhash64("fp"), F.col("parts"))).alias("shard")), "shards"
    )
    near = shared.select("fp", "anchor").distinct()
    holds = near.join(home.select("fp", "shard"), "fp").select("anchor", "shard").distinct()
    route = materialize(near.join(holds, "anchor").select("fp", "shard").distinct(), "route")
    load = materialize(route.join(home.select("fp", "chars"), "fp").groupBy("shard").agg(F.ceil(F.sum("chars") / STREAM_CHARS).cast("int").alias("blocks")), "load")
    streams = route.join(load, "shard").select("fp", "shard", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("is_ref"))
    refs = home.join(load, "shard").select("fp", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_ref"))
    # a text at home in the block's shard is both reference and stream; it comes as two rows
    work = refs.unionByName(streams).join(stretches.select("fp", "at", "stretch"), "fp")
    # one partition for a few groups each: merging small ones by bytes would give all automata to a few tasks
    tasks = load.agg(F.sum("blocks")).first()[0] or 1
    work = work.repartition(max(1, min(MOST_TASKS, -(-tasks // GROUPS_A_TASK))), "shard", "block")
    return work.groupBy("shard", "block").applyInArrow(_match(min_chars, pairs), "fp bigint, other bigint" if pairs else "fp bigint, start bigint, end bigint")


def shared_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, k: int = ANCHOR) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: records with at least ``min_chars`` consecutive characters in common.

    Null and shorter texts take no part; repeated ids count once; a span repeated
    inside one record only is no case.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    pairs = _matched(src, min_chars, k, True).toDF("a", "b").distinct()
    m = src.where(F.length("text") >= min_chars).select("id", F.xxhash64("text").alias("fp")).distinct()
    far = pairs.join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copied = m.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    own = m.join(copied, "fp", "left_semi").select("id", "fp")
    near = own.toDF("id_a", "fp").join(own.toDF("id_b", "fp"), "fp").where("id_a < id_b").select("id_a", "id_b")
    return far.unionByName(near).distinct()


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, k: int = ANCHOR) -> DataFrame:
    """``(id, start, end)``: maximal stretches of each record, 0-based and end-exclusive, made of spans shared elsewhere."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    spans = _matched(src, min_chars, k, False)
    m = src.where(F.length("text") >= min_chars).select("id", F.xxhash64("text").alias("fp"), F.length("text").cast("bigint").alias("n")).distinct()
    copied = m.groupBy("fp").agg(F.countDistinct("id").alias("c")).where("c > 1").select("fp")
    whole = m.join(copied, "fp", "left_semi").select("id", F.lit(0).cast("bigint").alias("start"), F.col("n").alias("end"))
    all_spans = m.select("id", "fp").join(spans, "fp").select("id", "start", "end").unionByName(whole)
    merged = F.aggregate(
        F.sort_array(F.collect_list(F.struct("start", "end"))),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return all_spans.groupBy("id").agg(merged.alias("s")).select("id", F.explode("s").alias("s")).select("id", "s.start", "s.end")


def shared_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, k: int = ANCHOR) -> DataFrame:
    """``(id, n_chars, spans, shared_chars, share)``: one row for each record; null texts have null characters and share 0."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    sums = shared_spans(src, "id", "text", min_chars, k).groupBy("id").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    base = src.groupBy("id").agg(F.max(F.length("text")).cast("bigint").alias("n_chars"))
    zero = F.lit(0).cast("bigint")
    return base.join(sums, "id", "left").select(
        "id", "n_chars", F.coalesce("spans", zero).alias("spans"), F.coalesce("shared_chars", zero).alias("shared_chars"), F.round(F.coalesce(F.col("shared_chars") / F.col("n_chars"), F.lit(0.0)), 6).alias("share")
    )
