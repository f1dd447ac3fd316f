"""Encoding a corpus with a public tokenizer through its distinct words.

Texts are split into pre-tokens (the tokenizer's own pattern). A block of texts
numbers its distinct words; a text then is the list of its words' numbers, in
order of position. All blocks' words are shuffled by word, each distinct word is
encoded once for the whole corpus, and its ids go back to the blocks that hold
it, where texts are put together again by position. What is shuffled grows with
blocks times distinct words, not with occurrences, so no frequent word is a hot
key: it counts once in a block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TOKENIZER_DIR = "/opt/tokenizers"
#: The split of byte-level BPE; fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Tokens of a vocabulary at most.
MOST_TOKENS = 2_000_000

_CACHE: dict[str, object] = {}


def ranks(tokenizer: str, folder: str = TOKENIZER_DIR) -> dict[bytes, int]:
    """Token bytes to ids of ``<tokenizer>.tiktoken``."""
    with open(f"{folder}/{tokenizer}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(tokenizer: str, folder: str, known: dict[bytes, int] | None = None):
    key = f"{folder}/{tokenizer}"
    if key not in _CACHE:
        import tiktoken

        _CACHE[key] = tiktoken.Encoding(tokenizer, pat_str=PATTERN, mergeable_ranks=known or ranks(tokenizer, folder), special_tokens={})
    return _CACHE[key]


def _shared_ranks(df: DataFrame, tokenizer: str, folder: str):
    """The vocabulary read on the driver and sent to the tasks, so that executors need no file of it; its size is checked."""
    known = ranks(tokenizer, folder)
    if len(known) > MOST_TOKENS:
        raise ValueError("the vocabulary is too large to send to each task")
    return df.sparkSession.sparkContext.broadcast(known)


def _splitter():
    if "split" not in _CACHE:
        import regex

        _CACHE["split"] = regex.compile(PATTERN).findall
    return _CACHE["split"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts (id, codes) and of words (code, word), block by block.

    A block is named by the task and its number in it; the name is written with
    both kinds of rows, so it needs no determinism.
    """
    import os
    import uuid

    split = _splitter()
    names = ["block", "id", "codes", "words"]

    def flush(ids: list, rows: list, seen: dict, id_type: pa.DataType) -> pa.RecordBatch:
        block = uuid.UUID(bytes=os.urandom(16)).int >> 65
        small = np.uint16 if len(seen) < 65536 else np.uint32
        codes = [None if r is None else np.array(r, small).tobytes() for r in rows]
        word_list = pa.array([list(seen)], pa.list_(pa.string()))
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (n + 1), pa.int64()),
                pa.array(ids + [None], id_type),
                pa.array(codes + [None], pa.binary()),
                pa.concat_arrays([pa.nulls(n, pa.list_(pa.string())), word_list]),
            ],
            names,
        )

    ids: list = []
    rows: list = []
    seen: dict[str, int] = {}
    chars = 0
    id_type = pa.int64()
    for b in batches:
        id_type = b.column(0).type
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            if not t:
                rows.append([])
                continue
            put = seen.setdefault
            rows.append([put(w, len(seen)) for w in split(t)])
            chars += len(t)
            if chars >= BLOCK_CHARS:
                yield flush(ids, rows, seen, id_type)
                ids, rows, seen, chars = [], [], {}, 0
    if ids:
        yield flush(ids, rows, seen, id_type)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, ids array<int>)``: one row for each distinct id, without special tokens.

    Null and empty texts have an empty list; a null id drops out; of an id with
    several texts the smallest counts. Special tokens' strings are ordinary text.
    """
    typ = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    if not src.groupBy("id").count().where("count > 1").isEmpty():
        src = distinct_texts(src, "id", "text")
    split = materialize(src.mapInArrow(_blocks, f"block bigint, id {typ}, codes binary, words array<string>"), "pretokens")
    words = split.where("words is not null").select("block", F.posexplode("words").alias("code", "word"))

    vocabulary = _shared_ranks(docs, tokenizer, folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoding(tokenizer, folder, vocabulary.value).encode_ordinary
        for b in batches:
            out = [np.array(one(w), np.int32).tobytes() for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["word", "ids"])

    known = words.select("word").distinct().mapInArrow(encode, "word string, ids binary")
    back = words.join(known, "word").select("block", "code", "ids")

    def join(texts: pa.Table, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(1).to_numpy())
        ids = table.column(2).combine_chunks().take(pa.array(order))
        off = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] // 4 if len(ids) else np.zeros(1, np.int64)
        flat = np.frombuffer(ids.buffers()[2] or b"", np.int32)[off[0] : off[-1]] if len(ids) else np.empty(0, np.int32)
        start, count = off[:-1] - off[0], np.diff(off).astype(np.int64)
        small = np.uint16 if len(start) < 65536 else np.uint32
        width = np.dtype(small).itemsize
        out = []
        for raw in texts.column(2).chunks:
            o = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            data = raw.buffers()[2]
            c = np.frombuffer(data, small, count=(o[-1] - o[0]) // width, offset=o[0]).astype(np.int64) if o[-1] > o[0] else np.empty(0, np.int64)
            n = count[c]
            ends = np.concatenate(([0], np.cumsum(n)))
            values = flat[np.repeat(start[c] - ends[:-1], n) + np.arange(ends[-1])]
            offsets = ends[(o - o[0]) // width].astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())))
        return pa.table([texts.column(1), pa.chunked_array(out, pa.list_(pa.int32()))], names=["id", "ids"])

    texts = split.where("words is null").select("block", "id", "codes")
    out = texts.groupBy("block").cogroup(back.toDF("of", "code", "ids").groupBy("of")).applyInArrow(join, f"id {typ}, ids array<int>")
    return out.toDF(id_col, "ids")


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each id: of several texts the smallest, null only if it has no other."""
    return docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(text_col).alias(text_col))


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, text)``: the text of each list of ids, by the token-byte table, which each task has whole (one entry a token, bounded)."""
    vocabulary = _shared_ranks(encoded, tokenizer, folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {v: k for k, v in vocabulary.value.items()}
        for b in batches:
            texts = [None if x is None else b"".join(map(by_id.__getitem__, x)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    typ = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(decode, f"{id_col} {typ}, text string")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, n_tokens)``: the length of each text in tokens."""
    return encode_corpus(docs, id_col, text_col, tokenizer, folder).select(id_col, F.size("ids").alias("n_tokens"))
