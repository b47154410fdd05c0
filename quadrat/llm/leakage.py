"""Evaluation passages in a corpus: windows of template words, hash-joined, with a check of the slots.

Texts are brought to words (runs of letters and digits of the compatibility form, case folded). A word
becomes a typed placeholder in the template if it is a number, a unit or a name; the words that the
placeholders stand for are the window's slots. Windows of ten words join on the hash of their
template; equal slots tell a copied passage, and slots that differ in one and the same way all over a document a
re-parameterised one.

What words the items use as words, and which templates they have, goes to the tasks as bit fields of a fixed
size. A word whose bit is set by another is no name on either side, and a window whose bit is set by another is
dropped by the join, so the results are the same for any number of items.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.sources.tables import cut

WINDOW, LEAST = 10, 5
# Units of measure that a template abstracts from.
UNITS = frozenset(
    "mm cm m km g kg t ha l ml kilogram kilograms gram grams tonne tonnes hectare hectares metre metres millimetre millimetres litre litres "
    "bag bags card cards trap traps hole holes stem stems nest nests burrow burrows capture captures night week degree degrees percent".split()
)
WORD_BITS, TEMPLATE_BITS = 22, 24  # fields of half a megabyte and of two
BATCH_CHARS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Words of a text: runs of letters and digits of its compatibility form, case folded."""
    return [w.casefold() for w in _raw_words(text)]


def _raw_words(text: str) -> list[str]:
    return _WORD.findall(text if text.isascii() else unicodedata.normalize("NFKC", text))


def plain_words(passage: str) -> Iterator[tuple[str, bool, bool]]:
    """(word, whether in small letters, whether with a capital inside a sentence) of each word of a passage."""
    for sentence in re.split(r"[.!?]\s+", unicodedata.normalize("NFKC", passage or "")):
        for i, w in enumerate(_WORD.findall(sentence)):
            yield w.casefold(), not w[0].isupper(), w[0].isupper() and i > 0


def template_word(word: str, plain: bool) -> str | None:
    """The placeholder of a word: <n> number, <u> unit, <x> name (a word the items don't use as one); None if it stays."""
    if word in UNITS:
        return "<u>"
    if any(c.isdigit() for c in word):
        return "<n>"
    return None if plain else "<x>"


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _bits(hashes: np.ndarray, field: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash's bit is set."""
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _field(rows: DataFrame, hash_col: str, bits: int) -> np.ndarray:
    """The bits of a column of hashes; no more places than the field has come to the driver."""
    places = rows.select(F.shiftrightunsigned(F.col(hash_col), 64 - bits).alias("p")).distinct().toArrow()["p"].to_numpy()
    flat = np.zeros(1 << bits, np.uint8)
    flat[places] = 1
    return np.packbits(flat, bitorder="little")


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n codes, in order."""
    out = np.full(len(codes) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ codes[i : i + len(out)]) * _MIX
            out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of a batch of texts, as arrays over all their words."""

    def __init__(self, texts: list[str | None], plain: np.ndarray) -> None:
        per = [_raw_words(t or "") for t in texts]
        self.sizes = np.fromiter(map(len, per), np.int64, len(per))
        codes, raw = pd.factorize(np.array([w for p in per for w in p], dtype=object)) if self.sizes.any() else (np.zeros(0, np.int64), [])
        self.distinct = [w.casefold() for w in raw]  # each is looked at once
        hashes = np.fromiter(map(word_hash, self.distinct), np.uint64, len(self.distinct))
        kinds = [template_word(w, p) for w, p in zip(self.distinct, _bits(hashes, plain, WORD_BITS))]
        self.codes, self.slot = codes, np.array([k is not None for k in kinds], bool)[codes] if len(codes) else np.zeros(0, bool)
        marks = {k: np.uint64(word_hash(k)) for k in ("<n>", "<u>", "<x>")}
        self.template = np.array([marks[k] if k else h for k, h in zip(kinds, hashes)], np.uint64)[codes]
        self.values = np.array([h if k else np.uint64(1) for k, h in zip(kinds, hashes)], np.uint64)[codes]
        self.doc = np.repeat(np.arange(len(per)), self.sizes)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, template hash, slot hash) of each window of n words within one text."""
        if len(self.codes) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        return at, _rolled(self.template, n)[at], _rolled(self.values, n)[at]

    def slots(self, at: int, n: int) -> list[str]:
        return [self.distinct[self.codes[i]] for i in range(at, at + n) if self.slot[i]]


def window_hashes(text: str | None, plain: np.ndarray, n: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(template hash, slot hash) of each window of n words; empty for null, empty and shorter texts."""
    return Windows([text], plain).of(n)[1:]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_CHARS characters, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _windows(df: DataFrame, id_col: str, text_col: str, plain: object, wanted: object, lengths: tuple[int, ...], *, whole: bool = False, values: bool = False) -> DataFrame:
    """(id, template, slots[, words]) of the distinct windows of each text, of wanted templates only if some are given.

    With ``whole`` a text shorter than the longest window is one window of its own length, if that is in ``lengths``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                w = Windows(texts[lo:hi], plain.value)
                docs, ts, ss, ws = [], [], [], []
                for n in lengths:
                    at, t, s = w.of(n)
                    if whole:
                        keep = (n == max(lengths)) | (w.sizes[w.doc[at]] == n)
                        at, t, s = at[keep], t[keep], s[keep]
                    if wanted is not None:
                        keep = _bits(t, wanted.value, TEMPLATE_BITS)
                        at, t, s = at[keep], t[keep], s[keep]
                    if len(at):
                        _, first = np.unique(np.stack([w.doc[at].astype(np.uint64), t, s]), axis=1, return_index=True)
                        docs.append(w.doc[at[first]])
                        ts.append(t[first])
                        ss.append(s[first])
                        ws += [w.slots(i, n) for i in at[first]] if values else []
                if docs:
                    cols = [keys.take(pa.array(np.concatenate(docs) + lo)), pa.array(np.concatenate(ts).view(np.int64)), pa.array(np.concatenate(ss).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols + ([pa.array(ws, pa.list_(pa.string()))] if values else []), names=[id_col, "template", "slots", "words"][: 4 if values else 3])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, template long, slots long" + (", words array<string>" if values else ""))


def _plain_field(items: DataFrame, texts: list[str]) -> np.ndarray:
    """Bits of the words that items use as words, not as names: in small letters, or with a capital only where a sentence starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, list[bool]] = {}
            for text in b["text"]:
                for w, small, middle in plain_words(text):
                    have = seen.setdefault(w, [False, False])
                    have[0] |= small
                    have[1] |= middle
            yield pd.DataFrame([(np.uint64(word_hash(w)).astype(np.int64), s, m) for w, (s, m) in seen.items()], columns=["h", "small", "middle"])

    flat = items.select(F.explode(F.array(*[F.col(t).cast("string") for t in texts])).alias("text")).mapInPandas(run, "h long, small boolean, middle boolean")
    return _field(flat.groupBy("h").agg(F.bool_or("small").alias("s"), F.bool_or("middle").alias("m")).where("s OR NOT m"), "h", WORD_BITS)


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, *, window: int = WINDOW) -> DataFrame:
    """(item, doc, n_windows): documents with ``window`` or more words in a row of an item's passage.

    Windows join on their template and pass if their slots agree, so a question with other numbers, names
    or units is no copy (reparameterised() reports it). Only windows whose template's bit an item has set leave the tasks, so a
    window that a third of all documents share goes no further than the pairs it makes. Null, empty and
    short texts have no windows; rows of one id count as one document.
    """
    sc = docs.sparkSession.sparkContext
    plain = sc.broadcast(_plain_field(items, [passage]))
    side = cut(_windows(items.select(item_id, passage), item_id, passage, plain, None, (window,)))
    found = _windows(docs, doc_id, text, plain, sc.broadcast(_field(side, "template", TEMPLATE_BITS)), (window,))
    return found.join(side, ["template", "slots"]).groupBy(item_id, doc_id).agg(F.count(F.lit(1)).alias("n_windows"))


def _plain_text(c: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def reparameterised(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, question: str | None = None, answer: str | None = None, *, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(item, doc, n_windows, n_copied, n_values, n_changed, is_consistent, has_answer): every item whose template a document has with other slots.

    Windows are those of the passage and of the question; one of ``least`` words or more that is shorter than ``window`` is
    a window as a whole. A document's window that is a copy of an item's is none of another item with that template. ``n_windows`` counts the pair's windows with the same template, ``n_copied`` those with the same slots too; a pair
    is listed if it has more of the first. Over all its windows, ``n_values`` are the item's values (numbers, names, units),
    ``n_changed`` those that the document replaces, and the pair ``is_consistent`` if it has one replacement for each value wherever it
    stands, as a question with new parameters has and chance does not. ``has_answer``: the document has the item's answer as it stands (null
    without one).
    """
    sc = docs.sparkSession.sparkContext
    texts = [passage, *([question] if question else [])]
    plain = sc.broadcast(_plain_field(items, texts))
    lengths = tuple(range(least, window + 1))
    parts = items.select(item_id, F.explode(F.array(*[F.col(t).cast("string") for t in texts])).alias("_part"))
    side = cut(_windows(parts, item_id, "_part", plain, None, lengths, whole=True, values=True).distinct())
    found = _windows(docs, doc_id, text, plain, sc.broadcast(_field(side, "template", TEMPLATE_BITS)), lengths, values=True)
    found = found.join(side.select("template", "slots", F.lit(True).alias("_copy")).distinct(), ["template", "slots"], "left")
    met = found.join(side.select(item_id, "template", F.col("slots").alias("_s"), F.col("words").alias("_w")), "template").where((F.col("slots") == F.col("_s")) | F.col("_copy").isNull())
    met = met.select(item_id, doc_id, (F.col("slots") == F.col("_s")).alias("same"), F.arrays_zip(F.col("_w").alias("a"), F.col("words").alias("b")).alias("z"))
    counts = met.groupBy(item_id, doc_id).agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("same").alias("n_copied")).where("n_windows > n_copied")
    met = met.join(counts.select(item_id, doc_id), [item_id, doc_id], "left_semi")
    values = met.select(item_id, doc_id, F.inline("z")).groupBy(item_id, doc_id, "a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    one = values.groupBy(item_id, doc_id).agg(F.count(F.lit(1)).cast("int").alias("n_values"), F.count_if((F.col("lo") != F.col("a")) | (F.col("hi") != F.col("a"))).cast("int").alias("n_changed"), F.bool_and(F.col("lo") == F.col("hi")).alias("is_consistent"))
    out = counts.join(one, [item_id, doc_id])
    if answer is None:
        return out.withColumn("has_answer", F.lit(None).cast("boolean"))
    given = items.groupBy(item_id).agg(F.min(answer).alias("_answer"))
    whole = docs.groupBy(doc_id).agg(F.max(_plain_text(F.col(text))).alias("_text"))
    out = out.join(given, item_id).join(whole.join(out.select(doc_id).distinct(), doc_id, "left_semi"), doc_id)
    return out.withColumn("has_answer", F.contains("_text", _plain_text(F.col("_answer")))).drop("_answer", "_text")
