"""Text decoded with the wrong encoding: finding it and restoring it by a noisy channel.

The corpus is reduced to its vocabulary of words with characters beyond ASCII and the number of distinct texts
that each is in. The channel turns a word's characters back to the bytes they may have been under each code
page: a lattice in which a path keeps a character, reads a run of bytes as the UTF-8 character they were, or
crosses lost bytes (U+FFFD) by a wildcard edge. The wildcard takes the bytes that a page leaves open where the
bytes beside it say which sequence was lost, else any character. A Viterbi search keeps the cheapest paths, and
each path's cost is taken together with that of its word in the corpus, the negative logarithm of its
frequency; the word as it stands is one of the readings. Wildcards that are still open are filled by the words
of the corpus that agree with every known character.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.sources.tables import cut

LOST = "�"
# Code pages that text is commonly taken for, and those it was commonly written in.
UTF8_MISREAD = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "iso8859_15", "koi8_r", "cp866")
PAGE_MISREAD = ("cp437", "cp850", "mac_roman", "cp1252", "cp1251", "cp1250", "koi8_r", "cp866", "cp1253")
WRITTEN_IN = ("cp1252", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp850")
STRONG = ("cp1252", "cp1254", "iso8859_15")  # pages in which a UTF-8 sequence hardly ever is text
CYRILLIC = ("cp1251", "koi8_r", "cp866")  # pages in which plain words can look like a sequence
# Ranges of characters that restored text may hold (Latin, Vietnamese, Greek, Cyrillic, CJK, punctuation, symbols, emoji).
RANGES = (
    (0xA0, 0x17F), (0x192, 0x192), (0x1A0, 0x1A1), (0x1AF, 0x1B0), (0x2C6, 0x2DC), (0x300, 0x303), (0x386, 0x3CE), (0x400, 0x45F), (0x490, 0x491), (0x1E00, 0x1EF9),
    (0x200B, 0x200F), (0x2010, 0x205F), (0x2070, 0x208E), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2150, 0x218F), (0x2190, 0x22FF), (0x2500, 0x27BF),
    (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFB00, 0xFB06), (0xFE0F, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF),
)
# Costs in natural logarithms, to be added to a word's negative log frequency. A kept character beyond ASCII, a sequence
# read, a change of page and a lost byte; a reading in another single-byte page; a character where no writing has it;
# and what no writing has at all. PLACE is what each page comes later in the list of the likely ones.
KEEP, READ, SWITCH, LOSS, PLACE = 3.0, 4.0, 2.0, 2.0, 0.001
PAGE, ODD, NEVER = math.log(8.0), 12.0, 1_000.0
UNSEEN = 1e-6  # frequency of a word that the corpus lacks
BEST = 6  # paths that the search keeps at each place of the lattice
STRETCH = 2_000
_RUN = re.compile("[^\x00-\x7f]+")


def plausible(ch: str) -> bool:
    o = ord(ch)
    return any(a <= o <= b for a, b in RANGES)


@lru_cache(maxsize=64)
def byte_map(page: str) -> dict[str, int]:
    """Byte of each character beyond ASCII of a code page; bytes that the page leaves open stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out.setdefault(bytes([b]).decode(page), b)
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):  # readers commonly let such bytes through as C1 controls or Latin-1
        if chr(b) not in out and (b < 160 or page == "cp1252"):
            out[chr(b)] = b
    return out


@lru_cache(maxsize=64)
def open_bytes(page: str) -> tuple[int, ...]:
    """Bytes that a code page leaves open and that strict readers turn to U+FFFD."""
    return tuple(b for b in range(128, 192) if not _decodes(b, page))


def _decodes(byte: int, page: str) -> bool:
    try:
        return bool(bytes([byte]).decode(page))
    except UnicodeDecodeError:
        return False


def _reads(chars: str, i: int, page: str) -> list[tuple[int, str, int]]:
    """(length, character, lost bytes) of the UTF-8 sequences that the characters from i on may have been, under a page."""
    table = byte_map(page)
    lead = table.get(chars[i])
    if lead is None or not 0xC2 <= lead <= 0xF4:
        return []
    n = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    part = chars[i + 1 : i + n]
    if len(part) < n - 1:
        return []
    tail = [open_bytes(page) if c == LOST else (table.get(c, 0),) for c in part]
    out = []
    for rest in product(*tail):
        if all(0x80 <= b <= 0xBF for b in rest):
            try:
                ch = bytes([lead, *rest]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if plausible(ch) or ch in "\x80\x99\x9d\x93\x94\x9c\x98":
                out.append((n, ch, part.count(LOST)))
    return out


def read_cost(place: int, n: int, ch: str, lost: int) -> float:
    """Cost of reading n characters as one, under the page at a place of UTF8_MISREAD; of characters else alike letters come first, then quotes."""
    kind = unicodedata.category(ch)
    return READ - 0.5 * (n - 2) + LOSS * lost + PLACE * place + (0.0 if kind[0] == "L" else 0.01 if kind in ("Pi", "Pf") else 0.02 if kind[0] in "PSN" else 0.03)


Step = tuple[int, int, str, str]


def _best_paths(run: str, best: int) -> list[tuple[float, list[Step]]]:
    """The cheapest paths over a run of characters beyond ASCII, each with its steps (from, to, text, page or '')."""
    n = len(run)
    # of each place and page of the last sequence: the cheapest entries (cost, order, hash of the text, from, entry before, text, page)
    at: list[dict[str, list[tuple]]] = [{} for _ in range(n + 1)]
    at[0][""] = [(0.0, 0, 0, 0, None, "", "")]
    order = 0

    def add(j: int, state: str, entry: tuple) -> None:
        have = at[j].setdefault(state, [])
        same = next((k for k, e in enumerate(have) if e[2] == entry[2]), None)
        if same is not None:
            if have[same][:2] > entry[:2]:
                have[same] = entry
        else:
            have.append(entry)
            if len(have) > 2 * best:
                have[:] = heapq.nsmallest(best, have, key=lambda e: e[:2])

    for i in range(n):
        if not at[i]:
            continue
        if run[i] == LOST:
            j = i + 1
            while j < n and run[j] == LOST:
                j += 1
            steps = [(j, run[i:j], "", LOSS)]
        else:
            steps = [(i + 1, run[i], "", KEEP)]
            steps += [(i + k, ch, p, read_cost(no, k, ch, lost)) for no, p in enumerate(UTF8_MISREAD) for k, ch, lost in _reads(run, i, p)]
        for state, entries in at[i].items():
            for e in heapq.nsmallest(best, entries, key=lambda e: e[:2]):
                for j, ch, page, cost in steps:
                    order += 1
                    add(j, page or state, (e[0] + cost + (SWITCH if page and state not in ("", page) else 0.0), order, hash((e[2], ch)), i, e, ch, page))
        at[i] = {}  # entries point at those before them
    out, seen = [], set()
    for e in sorted((e for es in at[n].values() for e in es), key=lambda e: e[:2]):
        if e[2] not in seen and len(out) < best:
            seen.add(e[2])
            steps, x, j = [], e, n
            while x[4] is not None:
                steps.append((x[3], j, x[5], x[6]))
                j, x = x[3], x[4]
            out.append((e[0], steps[::-1]))
    return out


def _cheapest(run: str) -> tuple[float, list[Step]]:
    """Cheapest path over a run, in stretches of STRETCH characters, each but the last only up to a step well before its end."""
    cost, out, at = 0.0, [], 0
    while at < len(run):
        end = min(len(run), at + STRETCH)
        part, steps = _best_paths(run[at:end], 1)[0]
        cost += part
        for i, j, ch, page in steps:
            if end < len(run) and j > STRETCH - 8:
                end = at + i
                break
            out.append((at + i, at + j, ch, page))
        at = max(end, at + 1)
    return cost, out


def viterbi(word: str, best: int = 1) -> list[tuple[float, str, int, int, str]]:
    """The ``best`` cheapest readings of a word: (cost, text, sequences read, bytes of the longest, page of the most).

    Sequences hold no ASCII, so each run beyond it has a lattice of its own, and a word's paths are the cheapest sums of
    its runs' paths. Runs of more than STRETCH characters, which are no words, have their cheapest path only.
    """
    sums: list[tuple[float, list[list[Step]]]] = [(0.0, [])]
    runs = list(_RUN.finditer(word))
    for m in runs:
        paths = _best_paths(m.group(), best) if len(m.group()) <= STRETCH else [_cheapest(m.group())]
        sums = heapq.nsmallest(best, [(c + d, s + [p]) for c, s in sums for d, p in paths], key=lambda x: x[0])
    out = []
    for cost, paths in sums:
        text, last, pages, longest = [], 0, Counter(), 0
        for m, steps in zip(runs, paths):
            text.append(word[last : m.start()])
            last = m.end()
            for i, j, ch, page in steps:
                text.append(ch)
                if page:
                    pages[page] += 1
                    longest = max(longest, j - i)
        page = min(pages, key=lambda p: (-pages[p], UTF8_MISREAD.index(p))) if pages else ""
        out.append((cost, "".join(text) + word[last:], sum(pages.values()), longest, page))
    return out


def _sure(text: str, reading: str, seqs: int, longest: int, page: str) -> bool:
    """Whether sequences are no text as they stand: several, one of three bytes or more, or of a page in which they mean nothing."""
    if page in CYRILLIC:
        return seqs > 1 and not any(c >= "\x80" and c in reading for c in text)
    return seqs > 1 or longest > 2 or page in STRONG


def readings(word: str, best: int = BEST) -> list[tuple[str, str, str, float]]:
    """(kind, page, text, cost) of what a word may have been, its cost set against that of keeping it; kinds: utf8, page, lost.

    UTF-8 sequences are read again and again, for text that was harmed more than once; the last reading has the next
    cheapest paths beside it. What is sure to be no text costs -NEVER, so that no frequency of the garbled word speaks for it;
    a single weak sequence costs nothing and is left to the frequencies. Texts may hold U+FFFD where bytes stay lost.
    """
    found: list[tuple[str, str, str, float]] = []
    text, sure, first, kind = word, LOST in word, "", "lost"
    while True:
        paths = viterbi(text, 1 if len(text) > STRETCH else best)
        _, new, seqs, longest, page = paths[0]
        if not seqs or new == text:
            break
        if first and not _sure(text, new, seqs, longest, page) and (page != first or page in CYRILLIC):
            break  # what is read already may be text: only what is sure, or of the page before, goes on
        first, kind = first or page, "utf8"
        sure = sure or _sure(text, new, seqs, longest, page)
        last, text = (text, paths), new
    if kind == "utf8":
        before, paths = last
        found += [("utf8", first, t, (-NEVER if sure else 0.0) + c - paths[0][0]) for c, t, n, _, _ in paths if n and t not in (word, before)]
    elif sure:
        found.append(("lost", "", word, -NEVER))
    if LOST not in word:
        marks = [c for c in word if c >= "\x80"]
        for page in PAGE_MISREAD:
            table = byte_map(page)
            if all(c in table for c in marks):
                raw = bytes(table.get(c, ord(c) if c < "\x80" else 63) for c in word)
                for written in WRITTEN_IN:
                    if written != page:
                        try:
                            new = raw.decode(written)
                        except UnicodeDecodeError:
                            continue
                        if new != word and all(c < "\x80" or plausible(c) for c in new):
                            found.append(("page", f"{written}>{page}", new, PAGE))
    return list({(k, t): (k, p, t, c) for k, p, t, c in reversed(found)}.values())


def open_pattern(text: str) -> tuple[str, str, int, int, str, int, int]:
    """(form, way, a, b, key, low, high) under which a text with lost bytes meets every word it may have been.

    n lost bytes are n / 4 to n characters beyond ASCII, so a word has from low to high characters, and its form, in which each
    run beyond ASCII is one U+FFFD, is that of the text. With lost bytes in one place (way 'one') a word of that form and size agrees if
    its first a and last b characters do, which are the key; a word has no character of ASCII but those. With several places
    the key is those ends ('ends'), or the longest known piece between lost bytes if it has more characters (a of them, 'inner'), and ``agrees`` decides.
    """
    known, runs = _pieces(text)
    inner = max(known[1:-1], key=len, default="")
    a, b, least = len(known[0]), len(known[-1]), sum(map(len, known))
    size = (least + sum((r + 3) // 4 for r in runs), least + sum(runs))
    if len(inner) > a + b:
        return _RUN.sub(LOST, text), "inner", len(inner), 0, inner, *size
    return _RUN.sub(LOST, text), "one" if len(runs) == 1 else "ends", a, b, known[0] + LOST + known[-1], *size


def _pieces(text: str) -> tuple[list[str], list[int]]:
    """The known pieces of a text and the numbers of lost bytes between them."""
    return re.split(LOST + "+", text), [len(m.group()) for m in re.finditer(LOST + "+", text)]


def marks(text: str) -> int:
    """A set of the known characters of a text and of their pairs, as 63 bits: a word that agrees with the text has all of them, and maybe others."""
    out = 0
    for piece in text.split(LOST):
        for c in piece:
            out |= 1 << ord(c) % 31
        for c, d in zip(piece, piece[1:]):
            out |= 1 << 31 + (7 * ord(c) + ord(d)) % 32
    return out


def agrees(text: str, word: str) -> bool:
    """Whether a word of the form of a text with lost bytes has all its known pieces with so many characters between them as the bytes may have been."""
    known, runs = _pieces(text)
    if not word.startswith(known[0]):
        return False
    at, bits = len(known[0]), 1  # a piece may begin at the place ``at`` + i for each bit i
    for no, (lost, piece) in enumerate(zip(runs, known[1:]), 1):
        at += (lost + 3) // 4
        more, width = lost - (lost + 3) // 4, 1
        while more:
            step = min(more, width)
            bits |= bits << step
            more, width = more - step, width + step
        if no == len(runs):
            end = len(word) - len(piece) - at
            return end >= 0 and bool(bits >> end & 1) and word.endswith(piece)
        bits &= (1 << max(0, len(word) - at + 1)) - 1
        bits = sum(1 << i for i in range(bits.bit_length()) if bits >> i & 1 and word.startswith(piece, at + i))
        if not bits:
            return False
        at += len(piece)
    return text == word


# One part of a text: a word with a digit on each side, if there is one; a digit; or other ASCII characters.
_PART = r"\d?[A-Za-z\x{80}-\x{10FFFF}]++\d?|\d|[\x00-\x7F&&[^A-Za-z0-9]]++"


# The words of those parts that hold a character beyond ASCII, found without taking the others apart; each character is looked at once.
_LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"
_FOREIGN = rf"(?:(?<!{_LETTER})\d)?(?<!{_LETTER})[A-Za-z]*+[^\x00-\x7F]{_LETTER}*+\d?"


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PART), F.lit(0))


def _word(part: Column) -> Column:
    """The word of a part: a digit before it counts (as 0) beside a character beyond ASCII, one behind it only if it has no letters of ASCII."""
    bare = F.regexp_replace(part, r"^\d(?=[A-Za-z])", "")
    return F.regexp_replace(F.when(bare.rlike("[A-Za-z]"), F.regexp_replace(bare, r"\d$", "")).otherwise(bare), r"\d", "0")


def words_of(text: Column) -> Column:
    """Distinct words with a character beyond ASCII; one linear pass."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_FOREIGN), F.lit(0)), _word))


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    return docs.where(F.col(text).rlike(r"[^\x00-\x7F]"))


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(token, n): in how many distinct texts of the whole corpus each word is; copies of a text count once, a text being its 64-bit hash."""
    rows = _with_words(docs, text).select(F.xxhash64(text).alias("_h"), F.explode(words_of(F.col(text))).alias("token"))
    return rows.groupBy("token").agg(F.count_distinct("_h").alias("n"))


def _odd(token: Column) -> Column:
    """Whether characters stand where no writing puts them: a symbol, mark or box between letters, or a capital beyond ASCII after a small letter."""
    return token.rlike(r"\p{L}[\p{S}\p{No}\p{Cc}¡¿§¶†‡•‰‚„…]+\p{L}|\p{Ll}(?![A-Z])\p{Lu}")


def damaged_tokens(words: DataFrame) -> DataFrame:
    """(token, restored, kind, page): the words of a vocabulary that are garbled, and what they were (null if unknown).

    Of a word's readings and the word as it stands, the one counts whose cost in the channel and in the corpus, the negative
    logarithm of its number of texts, is the lowest; words that are sure to be garbled are no evidence. So a sure UTF-8
    reading always counts, a weak one if the corpus has it as often as the word, and one in another page if the
    corpus has it 8 times as often; both if the corpus has it at all where the word has characters in odd places and the reading has none.
    Equal costs go to UTF-8, then to the likelier page, then by name. Words with U+FFFD are always garbled, also if it stands alone;
    if the corpus has no word that agrees with all their known characters, their original is unknown. Words of any length
    and any number of lost bytes, in any number of places, are looked for.
    """
    place = ["form", "way", "a", "b", "key", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, n in zip(b["token"], b["n"]):
                some = readings(t)
                sure = any(c < -NEVER / 2 for _, _, _, c in some)
                rows.append((t, n, "", "", t, 0.0, sure, marks(t), *[None] * len(place)))
                for kind, page, text, cost in some:
                    rows.append((t, n, kind, page, text, cost, sure, marks(text), *(open_pattern(text) if LOST in text else [None] * len(place))))
            yield pd.DataFrame(rows, columns=["token", "n", "kind", "page", "text", "cost", "sure", "marks", *place])

    schema = "token string, n long, kind string, page string, text string, cost double, sure boolean, marks long, form string, way string, a int, b int, key string, low int, high int"
    found = cut(words.mapInPandas(run, schema))  # the words are searched once
    clean = found.where("kind = '' AND NOT sure").select("token", "n", "marks")
    known = clean.select(F.col("token").alias("text"), F.col("n").alias("n_text"))
    whole = found.where("kind <> '' AND key IS NULL").join(known, "text", "left").select("token", "n", "kind", "page", "cost", F.col("text").alias("restored"), F.coalesce("n_text", F.lit(0)).alias("n_text"))
    misplaced = F.when(_odd(F.col("token")) & ~_odd(F.col("restored")), -ODD).otherwise(0.0)
    total = F.col("cost") + misplaced - F.log(F.greatest(F.col("n_text").cast("double"), F.lit(UNSEEN)))
    whole = whole.withColumn("total", total).where(F.col("total") <= -F.log(F.col("n").cast("double")))

    wanted = found.where("key IS NOT NULL").select("token", "n", "kind", "page", "cost", "text", "marks", *place)
    form = F.regexp_replace("token", r"[^\x00-\x7F]+", LOST)
    fillers = clean.withColumn("form", form).join(wanted.select("form").distinct(), "form", "left_semi").join(whole.select("token").distinct(), "token", "left_anti")
    sound = cut(fillers.select("form", F.length("token").alias("size"), F.col("token").alias("restored"), F.col("n").alias("n_text"), F.col("marks").alias("marked")))  # words that may fill a gap; read several times
    # the ends or pieces by which words of a form and size are wanted: a word has those keys only
    sizes = sound.select("form", "size").distinct()
    asked = wanted.select("form", "way", "a", "b", "low", "high").distinct().join(sizes, "form").where("size BETWEEN low AND high").select("form", "size", "way", "a", "b").distinct()
    ends = F.concat(F.left("restored", F.col("a")), F.lit(LOST), F.right("restored", F.col("b")))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("a") + 1), lambda i: F.substring("restored", i, F.col("a"))))
    top = F.min(F.struct((-F.col("n_text")).alias("less"), "restored")).alias("t")  # of words that agree alike: the commonest, then by name
    # one place: all words of a key agree, so one of each size stands for them; where nothing is known, it does before any join
    by_ends = sound.join(asked.where("way = 'one' AND a + b > 0"), ["form", "size"]).withColumn("key", ends)
    by_ends = by_ends.join(wanted.where("way = 'one'").select("form", "a", "b", "key").distinct(), ["form", "a", "b", "key"], "left_semi").groupBy("form", "a", "b", "key", "size").agg(top)
    bare = sound.where(F.col("form") == LOST).groupBy("form", "size").agg(top).withColumns({"a": F.lit(0), "b": F.lit(0), "key": F.lit(LOST)})
    single = wanted.where("way = 'one'").join(by_ends.unionByName(bare), ["form", "a", "b", "key"]).where("size BETWEEN low AND high")
    single = single.select("token", "n", "kind", "page", "cost", F.col("t.restored").alias("restored"), (-F.col("t.less")).alias("n_text"))
    # several places: words that have the key and all marks are compared
    met = sound.join(asked.where("way <> 'one'"), ["form", "size"]).withColumn("key", F.explode(F.when(F.col("way") == "inner", pieces).otherwise(F.array(ends))))
    met = wanted.where("way <> 'one'").join(met, ["form", "way", "a", "b", "key"]).where("size BETWEEN low AND high AND marked & marks = marks").select("token", "n", "kind", "page", "cost", "text", "restored", "n_text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[pd.Series([agrees(t, w) for t, w in zip(b["text"], b["restored"])], index=b.index, dtype=bool)].drop(columns="text")

    several = met.mapInPandas(compare, "token string, n long, kind string, page string, cost double, restored string, n_text long")
    filled = single.unionByName(several)
    unfilled = wanted.select("token", "n", "kind", "page", "cost", F.lit(None).cast("string").alias("restored"), F.lit(0).cast("long").alias("n_text"))
    both = whole.unionByName(filled.unionByName(unfilled).withColumn("total", F.col("cost") - F.log(F.greatest(F.col("n_text").cast("double"), F.lit(UNSEEN)))))
    rank = F.struct("total", (F.col("kind") != "utf8").alias("later"), F.array_position(F.lit([*UTF8_MISREAD]), F.col("page")).alias("place"), "page", "restored")
    best = both.groupBy("token").agg(F.min_by(F.struct("restored", "kind", "page"), rank).alias("b"))
    return best.select("token", "b.*")


def damaged_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, n_tokens, n_restored, pages): documents with garbled words. Null, empty and pure ASCII texts have none."""
    bad = damaged_tokens(vocabulary(docs, text))
    rows = _with_words(docs, text).select(doc_id, F.explode(words_of(F.col(text))).alias("token"))
    met = rows.join(bad, "token")
    return met.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n_tokens"), F.count("restored").alias("n_restored"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "page"))), ",").alias("pages"))


def restored_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, restored_text, n_restored, n_lost, spans): the whole text of each document with garbled words, those replaced whose original is known.

    ``n_restored`` and ``n_lost`` count the places of the text that were restored and that stay garbled; ``spans`` has
    the number of each such place among the text's parts, what stood there and what it became (null if unknown). Everything else stays as it
    is, digits beside a word included. Rows of one id must agree in their text.
    """
    bad = damaged_tokens(vocabulary(docs, text)).select("token", "restored")
    rows = _with_words(docs, text).select(doc_id, F.explode(words_of(F.col(text))).alias("token"))
    pairs = rows.join(bad, "token").groupBy(doc_id).agg(F.map_from_entries(F.collect_set(F.struct("token", "restored"))).alias("_m"))

    def whole(part: Column, i: Column) -> Column:
        word = _word(part)
        new = F.try_element_at(F.col("_m"), word)
        body = F.regexp_replace(F.regexp_replace(new, F.when(word.startswith("0"), "^0").otherwise("^(?!)"), F.lit("")), F.when(word.endswith("0"), "0$").otherwise("^(?!)"), F.lit(""))
        now = F.concat(F.regexp_extract(part, r"^\d", 0), body, F.regexp_extract(part, r"\d$", 0))
        return F.struct(i.alias("part_no"), part.alias("was"), now.alias("became"), F.map_contains_key(F.col("_m"), word).alias("hit"))

    parts = docs.join(pairs, doc_id).select(doc_id, "_m", _parts(F.col(text)).alias("_p")).select(doc_id, F.transform("_p", whole).alias("_w"))
    hits = parts.withColumn("spans", F.transform(F.filter("_w", lambda w: w["hit"]), lambda w: F.struct(w["part_no"], w["was"], w["became"])))
    n_lost = F.size(F.filter("spans", lambda s: s["became"].isNull()))
    return hits.select(doc_id, F.array_join(F.transform("_w", lambda w: F.coalesce(w["became"], w["was"])), "").alias("restored_text"), (F.size("spans") - n_lost).alias("n_restored"), n_lost.alias("n_lost"), "spans")
