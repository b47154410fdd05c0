"""Encoding a corpus with a public tokenizer over Arrow batches, with offsets, and decoding back."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BATCH_CHARS = 2_000_000


def _ship(df: DataFrame, path: str) -> None:
    """Sends the vocabulary file with the job if the driver has it, so that executors need no copy of their own."""
    sc = df.sparkSession.sparkContext
    if os.path.exists(path) and not any(str(f).endswith(f"/{os.path.basename(path)}") for f in sc.listFiles):
        sc.addFile(path)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    """One tokenizer for each Python worker, from the path or, where that is not, from the file sent with the job; special tokens in a text are ordinary text."""
    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores are shared out by tasks
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most BATCH_CHARS characters, one row at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > BATCH_CHARS:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def encode(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT_TOKENIZER, *, offsets: bool = False) -> DataFrame:
    """(id, ids ARRAY<INT>[, starts, ends ARRAY<INT>]) of every row, without special tokens.

    Null and empty texts give empty lists. Offsets are code points of the text: a token that holds a part of
    a character's bytes has the offsets of the whole character. Texts are never cut; batches are
    split by characters, so that a long text costs no more memory than its own tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                some = [x or "" for x in texts[lo:hi]]
                encoded = t.encode_batch(some, add_special_tokens=False) if offsets else t.encode_batch_fast(some, add_special_tokens=False)
                cols = [keys.slice(lo, hi - lo), pa.array([e.ids for e in encoded], pa.list_(pa.int32()))]
                if offsets:
                    cols += [pa.array([[o[k] for o in e.offsets] for e in encoded], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "starts", "ends"][: len(cols)])

    _ship(df, path)
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str, ids_col: str = "ids", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, text): token ids back to text through the reversed byte table.

    The characters of all tokens are turned to bytes before they are decoded, so a character split between
    tokens comes back whole; bytes that are no UTF-8 become U+FFFD. Null lists give null, empty ones ''.
    Unknown ids raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_of_char()
        vocab = {i: bytes(table[c] for c in s) if all(c in table for c in s) else s.encode() for s, i in _tokenizer(path).get_vocab().items()}
        for b in batches:
            texts = [None if ids is None else b"".join(vocab[i] for i in ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    _ship(df, path)
    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
