"""Splitting oversized items at natural boundaries, by packing a structure tree.

A text is a tree: sections under headings, blocks between blank lines, fenced
blocks, list items and statements by indentation, then lines, sentences, words.
A node's children are found only when it is too large. Their pieces are merged
bottom-up with their siblings as far as the limits allow, so a cut falls on the
highest boundary that can be had.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, MAX_CHARS = 320, 4000
OVERLAP_TOKENS, OVERLAP_CHARS = 32, 400
_TOKEN = re.compile(r"[^ \t\r\n]+")
_HEADING = re.compile(r"(#{1,6})[ \t]+\S")
_FENCE = re.compile(r"[ \t]*(```|~~~)")
#: In-line places to cut after, best first.
_PLACES = (re.compile(r"[.!?;]['\")\]]*[ \t]+"), re.compile(r"[ \t]+"), re.compile(r"[;,{}()\[\]<>|]"))


class _Text:
    """Lines of one text with running sums of characters and tokens."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.lines = text.split("\n")
        ends = len(self.lines) - 1
        self.lines = [x + "\n" if i < ends else x for i, x in enumerate(self.lines)]
        if self.lines[-1] == "" and len(self.lines) > 1:
            self.lines.pop()
        self.at, self.tokens = [0], [0]
        for x in self.lines:
            self.at.append(self.at[-1] + len(x))
            self.tokens.append(self.tokens[-1] + len(_TOKEN.findall(x)))
        self.blank = [not x.strip(" \t\r\n") for x in self.lines]
        self.indent = [len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip(" ")) for x in self.lines]
        self.fenced, self.heading = [False] * len(self.lines), [0] * len(self.lines)
        mark = ""
        for i, x in enumerate(self.lines):
            m = _FENCE.match(x)
            if mark:
                self.fenced[i] = True
                if m and m[1] == mark:
                    mark = ""
            elif m:
                mark = m[1]
            elif h := _HEADING.match(x):
                self.heading[i] = len(h[1])

    def children(self, a: int, b: int) -> list[tuple[int, int]]:
        """The parts of lines [a, b) at the highest kind of boundary inside; one part if there is none."""
        inside = range(a + 1, b)
        levels = [self.heading[i] for i in inside if self.heading[i]]
        if levels:
            top = min(levels)
            return _parts(a, b, [i for i in inside if self.heading[i] == top])
        open_ = [i for i in inside if not self.fenced[i] and not self.blank[i]]
        after_blank = [i for i in open_ if self.blank[i - 1]]
        if after_blank:
            least = min(self.indent[i] for i in after_blank)
            cuts = [i for i in after_blank if self.indent[i] == least]
            floor = min((self.indent[i] for i in range(a, b) if not self.blank[i]), default=0)
            if least == floor or len(cuts) > 1:
                return _parts(a, b, cuts)
        shown = [i for i in open_ or inside if not self.blank[i]]
        if shown:
            least = min(self.indent[i] for i in shown)
            # a line that only closes a block stays with it
            cuts = [i for i in shown if self.indent[i] == least and not re.match(r"[ \t]*[\])}]+[;,]?[ \t\r]*$", self.lines[i].rstrip("\n"))]
            if cuts:
                return _parts(a, b, cuts)
        return _parts(a, b, list(inside))


def _parts(a: int, b: int, cuts: list[int]) -> list[tuple[int, int]]:
    marks = [a, *cuts, b]
    return [(x, y) for x, y in zip(marks, marks[1:]) if y > x]


def _inline(text: str, base: int, tokens: int, chars: int) -> list[tuple[int, int]]:
    """Cut one long line: (start, end) offsets, each part within the limits."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + chars)
        for i, m in enumerate(_TOKEN.finditer(text, at, end)):
            if i == tokens:
                end = m.start()
                break
        if end < len(text):
            for place in _PLACES:
                cuts = [m.end() for m in place.finditer(text, at + (end - at) // 2, end)]
                if cuts:
                    end = cuts[-1]
                    break
        out.append((base + at, base + end))
        at = end
    return out


def tail(text: str, tokens: int = OVERLAP_TOKENS, chars: int = OVERLAP_CHARS) -> str:
    """What the next piece repeats: the last line, with blank lines after it, or as much of its end as allowed."""
    body = text.rstrip(" \t\r\n")
    start = body.rfind("\n") + 1
    line = text[start:]
    if len(line) > chars:
        line = line[-chars:]
    found = list(_TOKEN.finditer(line))
    if len(found) > tokens:
        line = line[found[-tokens].start() :]
    return line


def split_text(text: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap_tokens: int = OVERLAP_TOKENS, overlap_chars: int = OVERLAP_CHARS) -> list[tuple[int, int, int]]:
    """``(start, end, overlap)``: pieces by offsets of their own text, and how many characters before it they repeat.

    With what it repeats, each piece is within both limits; own texts follow each
    other without gaps. A text within the limits is one piece.
    """
    if overlap_tokens >= max_tokens or overlap_chars >= max_chars:
        raise ValueError("the overlap must be smaller than the limit")
    if not text:
        return []
    t = _Text(text)
    room_t, room_c = max_tokens - overlap_tokens, max_chars - overlap_chars

    def fits(a: int, b: int) -> bool:
        return t.tokens[b] - t.tokens[a] <= room_t and t.at[b] - t.at[a] <= room_c

    def merge(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Join neighbours (start, end, tokens) from the left while they fit."""
        out = parts[:1]
        for s, e, n in parts[1:]:
            s0, _, n0 = out[-1]
            if e - s0 <= room_c and n0 + n <= room_t:
                out[-1] = (s0, e, n0 + n)
            else:
                out.append((s, e, n))
        return out

    # the tree, depth first with a stack of its own, as texts may nest deeply
    def pieces(a: int, b: int, depth: int = 0) -> list[tuple[int, int, int]]:
        if fits(a, b):
            return [(t.at[a], t.at[b], t.tokens[b] - t.tokens[a])]
        if b - a == 1:
            return [(s, e, len(_TOKEN.findall(text, s, e))) for s, e in _inline(t.lines[a], t.at[a], room_t, room_c)]
        kids = t.children(a, b) if depth < 200 else _parts(a, b, list(range(a + 1, b)))
        if len(kids) == 1:
            kids = _parts(a, b, list(range(a + 1, b)))
        return merge([p for x, y in kids for p in pieces(x, y, depth + 1)])

    found = pieces(0, len(t.lines))
    # with the true overlaps known, neighbours may fit after all
    out: list[tuple[int, int, int]] = []
    for s, e, _ in found:
        if out:
            s0, _, o = out[-1]
            if e - s0 + o <= max_chars and len(_TOKEN.findall(text, s0 - o, e)) <= max_tokens:
                out[-1] = (s0, e, o)
                continue
            back = tail(text[out[-1][0] : out[-1][1]], overlap_tokens, overlap_chars)
            out.append((s, e, len(back)))
        else:
            out.append((s, e, 0))
    return out


def split_oversized(
    chunks: DataFrame,
    id_col: str = "id",
    text_col: str = "content",
    start_col: str = "start_line",
    max_tokens: int = MAX_TOKENS,
    max_chars: int = MAX_CHARS,
    overlap_tokens: int = OVERLAP_TOKENS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``(id, piece, content, start_line, end_line, tokens_approx, overlap_chars)`` of items above a limit.

    Tokens are the longest runs of characters other than space, tab, CR and LF.
    Null or small texts and null ids give no rows. Repeated rows of an id count
    once; of different texts under one id the smallest counts. A null start line
    counts as 1. Lines are counted with what a piece repeats. Only oversized
    texts leave the scan; other columns are not read.
    """
    typ = dict(chunks.dtypes)[id_col]
    n_tokens = F.size(F.regexp_extract_all(text_col, F.lit(r"([^ \t\r\n]+)"), F.lit(1)))
    large = (F.length(text_col) > max_chars) | ((F.length(text_col) > 2 * max_tokens) & (n_tokens > max_tokens))
    rows = chunks.where(F.col(id_col).isNotNull() & large).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(text_col).alias("content"), F.col(start_col).cast("int").alias("start_line"))).alias("r"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: list[tuple] = []
                for i, text, first in zip(*(part.column(c).to_pylist() for c in range(3))):
                    for k, (s, e, o) in enumerate(split_text(text, max_tokens, max_chars, overlap_tokens, overlap_chars)):
                        own = text[s - o : e]
                        line = (first if first is not None else 1) + text.count("\n", 0, s - o)
                        last = line + own.count("\n") - (own.endswith("\n"))
                        out.append((i, k, own, line, last, len(_TOKEN.findall(own)), o))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], part.column(0).type), *(pa.array(x, pa.int32()) if j != 2 else pa.array(x, pa.string()) for j, x in enumerate(cols) if j)],
                        ["id", "piece", "content", "start_line", "end_line", "tokens_approx", "overlap_chars"],
                    )

    return rows.select("id", "r.content", "r.start_line").mapInArrow(cut, f"id {typ}, piece int, content string, start_line int, end_line int, tokens_approx int, overlap_chars int")


def misfits(
    pieces: DataFrame, chunks: DataFrame, id_col: str = "id", text_col: str = "content", start_col: str = "start_line", max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS,
    overlap_tokens: int = OVERLAP_TOKENS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """For each item of one text that is cut, ``(id, too_large, miscounted, wrong_overlap, not_whole, wrong_lines)``: counts of what is wrong.

    ``too_large`` pieces, ``miscounted`` tokens, ``wrong_overlap`` (a piece must
    begin with the end of the one before: its last line if that is small enough,
    else no more than that), ``not_whole`` items whose pieces without what they
    repeat do not make up the text, ``wrong_lines`` that do not follow from the text.
    """
    typ = dict(chunks.dtypes)[id_col]
    texts = chunks.groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(text_col).alias("content"), F.col(start_col).cast("int").alias("start_line"))).alias("r"))
    parts = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece", "content", "start_line", "end_line", "tokens_approx", "overlap_chars"))).alias("p"))
    both = parts.join(texts, "id").select("id", "r.content", "r.start_line", "p")
    names = ["too_large", "miscounted", "wrong_overlap", "not_whole", "wrong_lines"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, first, ps = (b.column(k)[i].as_py() for k in (1, 2, 3))
                bad, whole, line, before = [0] * 5, "", first if first is not None else 1, ""
                for p in ps:
                    own, o = p["content"], p["overlap_chars"]
                    count = len(_TOKEN.findall(own))
                    bad[0] += len(own) > max_chars or count > max_tokens
                    bad[1] += count != p["tokens_approx"]
                    # the end of what came before, without its line end, is repeated as far as the limits allow
                    said, rest = own[:o], whole[len(whole) - len(before) :].rstrip(" \t\r\n")
                    last = whole[len(whole) - len(before) + rest.rfind("\n") + 1 :]
                    small = len(last) <= overlap_chars and len(_TOKEN.findall(last)) <= overlap_tokens
                    fits = 0 < o <= overlap_chars and len(_TOKEN.findall(said)) <= overlap_tokens
                    bad[2] += o != 0 if not before else not whole.endswith(said) or (said != last if small else not fits)
                    at = line + whole.count("\n", 0, len(whole) - o)
                    bad[4] += p["start_line"] != at or p["end_line"] != at + own.count("\n") - own.endswith("\n")
                    whole, before = whole + own[o:], own[o:]
                bad[3] = int(whole != text)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([x], pa.int64()) for x in bad)], ["id", *names])

    return both.mapInArrow(check, f"id {typ}, " + ", ".join(f"{n} bigint" for n in names))
