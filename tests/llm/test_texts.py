"""Encoding, leakage and garbled text on small fixtures and against brute force."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrat.llm import encode, garbled, leakage
from tests.conftest import rows

TEXTS = [None, "", " ", "wheat at 12 °C", "<|endoftext|> as text", "地面覆盖约 51%", "👩‍🌾 🐭", "﻿A B\x00C", "é", "x" * 300_000, "mice " * 20_000, "wheat at 12 °C"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, template int")


def test_ids_round_trip_and_defined_empties(spark, docs) -> None:
    ids = {r.doc_id: r.ids for r in encode.encode(docs, "doc_id", "text").collect()}
    assert ids[0] == ids[1] == [] and ids[3] == ids[11] and len(ids[4]) > 1
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(docs, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encode.encode(docs.where("false"), "doc_id", "text").count() == 0


def test_ids_are_those_of_a_second_library(spark, docs) -> None:
    import base64
    import importlib.util

    import tiktoken

    spec = importlib.util.spec_from_file_location("tok", "/opt/tokenizers/__init__.py")
    tok = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(tok)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in encode.encode(docs.where("doc_id <> 9"), "doc_id", "text").collect():
        assert r.ids == enc.encode_ordinary(TEXTS[r.doc_id] or ""), r.doc_id


def test_offsets_cover_the_text(spark, docs) -> None:
    for r in encode.encode(docs, "doc_id", "text", offsets=True).collect():
        text = TEXTS[r.doc_id] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert not text or (r.starts[0] == 0 and max(r.ends) == len(text))


def test_decoding_broken_ids(spark) -> None:
    df = spark.createDataFrame([(1, None), (2, []), (3, [encode._tokenizer(encode.DEFAULT_TOKENIZER).token_to_id("Ã")])], "doc_id long, ids array<int>")
    assert rows(encode.decode(df, "doc_id")) == [(1, None), (2, ""), (3, "�")]


WORDS = "Under zinc bait the ripe oats of {a} kept {n} {u}, mostly through summer and the {m} survey found fewer nests than in {y} near the creek".split(" ")


def passage(rng: random.Random) -> str:
    fill = {"{a}": rng.choice(["Wiworra", "Sasulo", "Yeeyolt"]), "{n}": str(rng.randint(1, 999)), "{u},": rng.choice(["bags,", "holes,"]), "{m}": rng.choice(["June", "May"]), "{y}": str(rng.randint(2000, 2020))}
    return " ".join(fill.get(w, w) for w in WORDS)


def brute(text: str | None, item: str | None) -> bool:
    import re

    words = lambda t: [w.casefold() for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or ""))]
    a, b = words(text), words(item)
    grams = {tuple(b[i : i + 10]) for i in range(len(b) - 9)}
    return any(tuple(a[i : i + 10]) in grams for i in range(len(a) - 9))


def test_leaks_against_brute_force(spark) -> None:
    rng = random.Random(4)
    items = [(i, passage(rng)) for i in range(12)] + [(90, None), (91, ""), (92, "too short")]
    texts: list[str | None] = [None, "", "short", passage(random.Random(99))]
    for _ in range(60):
        p = rng.choice(items[:12])[1].split(" ")
        i, n = rng.randrange(12), rng.choice([8, 9, 10, 11, 20])
        t = " ".join(p[i : i + n])
        t = rng.choice([t, t.upper(), t.replace(" ", "\n"), t.replace(" ", " _ "), t.translate({ord(str(k)): 0xFF10 + k for k in range(10)}), t.replace("fi", "ﬁ")])
        texts.append("Note: " + t + " ends here.")
    texts += ["filler " * 30_000 + items[0][1], texts[10], texts[10]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, slots int")
    its = spark.createDataFrame([(*r, "x") for r in items], "item_id long, passage string, template string")
    got = [(r.item_id, r.doc_id) for r in leakage.leaked(docs, "doc_id", "text", its, "item_id", "passage").collect()]
    want = {(i, k) for i, p in items for k, t in enumerate(texts) if brute(t, p)}
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    again = leakage.reparameterised(docs, "doc_id", "text", its, "item_id", "passage").collect()
    assert 3 in {r.doc_id for r in again}
    assert leakage.leaked(docs.where("false"), "doc_id", "text", its, "item_id", "passage").count() == 0
    assert leakage.leaked(docs, "doc_id", "text", its.where("false"), "item_id", "passage").count() == 0


def test_many_items_are_no_limit(spark) -> None:
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=14))) for i in range(20_000)]
    its = spark.createDataFrame(items, "item_id long, passage string")
    docs = spark.createDataFrame([(k, "see: " + items[i][1][:-1] + "!") for k, i in enumerate((5, 9_999, 10_001, 19_999))], "doc_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leakage.leaked(docs, "doc_id", "text", its, "item_id", "passage").collect()}
    assert got == {(5, 0), (9_999, 1), (10_001, 2), (19_999, 3)}


def test_slots_have_to_be_replaced_consistently(spark) -> None:
    line = "the survey of {a} found {n} {u} in spring and the growers of {a} baited {n} {u} again before winter came"
    fill = lambda a, b, n="40", m="40", u="bags": line.replace("{a}", a, 1).replace("{a}", b).replace("{n}", n, 1).replace("{n}", m).replace("{u}", u)
    items = [(1, fill("Wilson", "Wilson"), "How many bags did the growers near Wilson bait?", "40"), (2, fill("Mason", "Mason", "7", "7"), None, None), (3, None, "", "x")]
    texts = [fill("Harper", "Harper"), fill("Wilson", "Harper"), fill("Wilson", "Wilson"), fill("HARPER", "Harper", "9", "9", "cards"), "so how many bags did the growers near Harper bait?", None, "", "Mason " * 5_000]
    its = spark.createDataFrame([(*r, 1) for r in items], "item_id long, passage string, question string, answer string, template int")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {(r.item_id, r.doc_id): r for r in leakage.reparameterised(docs, "doc_id", "text", its, "item_id", "passage", "question", "answer").collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 3), (1, 4), (2, 0), (2, 1), (2, 3)}  # text 2 is a copy of item 1
    assert got[1, 0].is_consistent and not got[1, 1].is_consistent and got[1, 3].is_consistent and got[1, 4].is_consistent
    assert (got[1, 0].n_values, got[1, 0].n_changed, got[1, 3].n_changed) == (3, 1, 3)
    assert got[1, 0].has_answer and not got[1, 3].has_answer and got[2, 0].has_answer is None
    assert leakage.reparameterised(docs.where("false"), "doc_id", "text", its, "item_id", "passage", "question", "answer").count() == 0
    assert leakage.reparameterised(docs, "doc_id", "text", its.where("false"), "item_id", "passage", "question", "answer").count() == 0


GOOD = ["Jürgen’s café notes: “¼ of cards chewed”", "La señal fue mínima: 10 % de las tarjetas", "ATENÇÃO: NÃO À noite", "Ночью было «7 °C», СССР»", "地面覆盖约 51%,作物处于开花期。", "Độ che phủ mặt đất", "¯\\_(ツ)_/¯ 👩‍🌾", "l’été, où l’activité s’élève – Âge", "naïve 11 × 7 ≈ …", "Straße: Größe, Übergröße", None, ""]


def damaged(text: str, page: str) -> str:
    return "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in text.encode())


def found(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, token int")
    return {r.doc_id for r in garbled.damaged_documents(df, "doc_id", "text").collect()}


def test_good_text_of_many_languages_is_left_alone(spark) -> None:
    assert found(spark, GOOD) == set()
    assert found(spark, GOOD * 30) == set()
    assert found(spark, []) == set() and found(spark, [None, "", "plain"]) == set()


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
def test_utf8_read_in_another_page(spark, page) -> None:
    texts = GOOD * 5
    bad = [damaged(t, page) for t in GOOD[:3]] + ["half " + damaged("é “x”", page)]
    n = len(texts)
    assert found(spark, texts + bad) == set(range(n, n + len(bad)))
    df = spark.createDataFrame([(t,) for t in texts + bad], "text string")
    back = {r.token: r.restored for r in garbled.damaged_tokens(garbled.vocabulary(df, "text")).collect()}
    assert back[damaged("Jürgen’s", page)] == "Jürgen’s"


def test_twice_damaged_lost_bytes_and_pages_with_witnesses(spark) -> None:
    twice = damaged(damaged("It’s naïve", "cp1252"), "cp1252")
    lost = "J�rgen�s caf� notes"
    page = "Jürgen’s café".encode("cp1252").decode("mac_roman")
    texts = GOOD * 20 + [twice, lost, page, "x" * 50_000 + "é" * 5_000]
    n = len(GOOD) * 20
    assert found(spark, texts) == {n, n + 1, n + 2}
    back = {r.token: r.restored for r in garbled.damaged_tokens(garbled.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"), "text")).collect()}
    assert back["J�rgen�s"] == "Jürgen’s" and back[page.split()[1]] == "café" and back[twice.split()[1]] == "naïve"


@given(st.text(alphabet="aéü’–çã°Ж地", min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_viterbi_restores_any_text(text: str) -> None:
    bad = damaged(text, "cp1252")
    assert garbled.viterbi(bad)[0][1] == text or bad == text


def test_long_runs_are_read_in_stretches() -> None:
    text = "é地’地é" * 3_000
    assert garbled.viterbi(damaged(text, "cp1252"))[0][1] == text
    assert garbled.viterbi(text)[0][1] == text


def test_words_of_is_linear_and_distinct(spark) -> None:
    df = spark.createDataFrame([("a" * 500_000 + "1" * 500_000 + " é1 é22 é3\té3 cafés12 7°C",)], "t string").select(garbled.words_of(F.col("t")).alias("k"))
    assert df.head().k == ["é0", "cafés", "0°C"]


@given(st.lists(st.text(alphabet="ab1 é°-", max_size=12), min_size=30, max_size=60))
@settings(max_examples=8, deadline=None)
def test_words_are_those_of_the_parts(spark, texts) -> None:
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parts = F.array_distinct(F.transform(F.filter(garbled._parts(F.col("t")), lambda p: p.rlike(r"[^\x00-\x7F]")), garbled._word))
    got = df.select("t", garbled.words_of(F.col("t")).alias("a"), parts.alias("b"), F.array_join(garbled._parts(F.col("t")), "").alias("c")).collect()
    assert all(r.a == r.b and r.c == r.t for r in got)


def test_copies_of_a_damaged_text_do_not_outvote_its_witnesses(spark) -> None:
    page = "Straße: Größe, café, 7".encode("cp1252").decode("mac_roman")
    clean = [f"Die Straße {w} Größe. Und café {w}" for w in ("am", "im", "zum")]
    texts = clean + [page] * 200
    assert found(spark, texts) == set(range(len(clean), len(texts)))


def test_whole_texts_are_restored_with_their_own_digits(spark) -> None:
    texts = ["Jürgen’s\tcafé  notes:\n25°C, then 7°C–31°C on 10/12", "nothing garbled: 3°C at 12", None]  # a single weak sequence needs the witness
    df = spark.createDataFrame([(i, t if i else damaged(t, "cp1252")) for i, t in enumerate(texts)], "doc_id long, text string")
    assert rows(garbled.restored_documents(df, "doc_id", "text").select("doc_id", "restored_text")) == [(0, texts[0])]


def restored(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in garbled.restored_documents(df, "doc_id", "text").collect()}


@pytest.mark.parametrize(("bad", "good"), [("47Â°C", "47°C"), ("cafÃ©", "café"), ("he said â€œnoâ€�", "he said “no”"), ("Ã�frica", None)])
def test_single_words_without_witnesses(spark, bad, good) -> None:
    got = restored(spark, [bad])
    assert got[0].restored_text == good if good else got[0].n_restored + got[0].n_lost == 1


def test_lost_bytes_are_filled_by_words_that_agree_with_every_known_character(spark) -> None:
    clean = ["un café noir", "tres cafés", "très élevé", "très bien", "três", "Größe", "Grüße", "25 °C and £5", "élève"]
    bad = ["caf�12", "�l�ve", "�lev�", "Gr��e", "Grü�e", "tr�s", "£�", "�zz�"]
    got = restored(spark, clean + bad)
    out = [got[len(clean) + i].restored_text for i in range(len(bad))]
    assert out[:6] == ["café12", "élève", "élevé", "Größe", "Grüße", "très"] and out[7] == "�zz�"
    assert set(got) == set(range(len(clean), len(clean) + len(bad)))
    assert (got[len(clean) + 7].n_restored, got[len(clean) + 7].n_lost) == (0, 1)


def test_lost_bytes_of_any_number_place_and_length_of_word_are_filled(spark) -> None:
    passage = "去年冬天以后小麦田里的老鼠数量明显增加农民在收获之前每个月都要检查田地周围的洞穴并且记录下来"  # more than 40 characters
    clean = ["преобразование", passage, "Überführungsstück", "поле", "жизнь"]
    bad = {"преобр\ufffd\ufffd\ufffd\ufffd\ufffd\ufffd\ufffd\ufffd\ufffd\ufffdание": clean[0], passage[:20] + "\ufffd" + passage[21:]: passage, "п\ufffdе\ufffdбразо\ufffdание": clean[0], "\ufffdреобразовани\ufffd": clean[0],
           "\ufffdberf\ufffdhrungsst\ufffdck": clean[2], "\ufffd\ufffdол\ufffd": clean[3], "\ufffd" * 10: clean[4], "преобр\ufffdмание": None, passage[:20] + "\ufffd" + passage[20:]: None}
    texts = [*clean, "eine жизнь", *bad]
    got = {r.token: r.restored for r in garbled.damaged_tokens(garbled.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"), "text")).collect()}
    assert got == bad


def test_fillings_against_every_word_of_the_corpus(spark) -> None:
    rng = random.Random(8)
    words = {w: rng.randint(1, 3) for w in ("".join(rng.choices("жзиыaé—", k=rng.choice([3, 4, 5, 6, 60]))) for _ in range(250)) if not w.isascii()}
    bad = {rule_of for w in words for _ in range(3) if "\ufffd" in (rule_of := "".join(c if c == "a" or rng.random() < 0.6 else "\ufffd" * rng.choice([1, 1, 2]) for c in w))}
    rows_ = garbled.damaged_tokens(spark.createDataFrame([*words.items(), *((b, 1) for b in bad)], "token string, n long")).collect()
    sure = {r.token for r in rows_ if "\ufffd" not in r.token}
    assert {r.token for r in rows_} - sure == bad and len(bad) > 300
    for r in rows_:
        if r.token in bad and r.kind == "lost":
            rule = re.compile("".join(f"[^\x00-\x7f]{{{(len(m) + 3) // 4},{len(m)}}}" if m[0] == "\ufffd" else re.escape(m) for m in re.findall("\ufffd+|[^\ufffd]+", r.token)))
            fits = [w for w in words if w not in sure and rule.fullmatch(w)]
            assert r.restored == (min(fits, key=lambda w: (-words[w], w)) if fits else None)


@given(st.lists(st.tuples(st.integers(1, 9), st.text(alphabet="яé", min_size=1, max_size=2)), min_size=1, max_size=4), st.text(alphabet="яé", min_size=1, max_size=14))
@settings(max_examples=200, deadline=None)
def test_agreement_is_that_of_a_regular_expression(parts, word) -> None:
    text = "".join("\ufffd" * n + piece for n, piece in parts)
    rule = "".join(f"[^\x00-\x7f]{{{(n + 3) // 4},{n}}}{piece}" for n, piece in parts)
    assert garbled.agrees(text, word) == bool(re.fullmatch(rule, word))
    assert not garbled.agrees(text, word) or garbled.marks(word) & garbled.marks(text) == garbled.marks(text)
    assert garbled.agrees(text[::-1], word) == bool(re.fullmatch("".join(f"{p[::-1]}[^\x00-\x7f]{{{(n + 3) // 4},{n}}}" for n, p in reversed(parts)), word))


def test_a_word_garbled_in_another_way_is_no_better_witness(spark) -> None:
    texts = ["Für alle", "F├╝r alle", damaged("Für", "cp1251") + " andere"]
    got = restored(spark, texts)
    assert got[1].restored_text == "Für alle"


@pytest.mark.parametrize("rounds", [2, 4, 5])
def test_text_garbled_many_times(spark, rounds) -> None:
    text = "Übergröße für 7 Mäuse"
    for _ in range(rounds):
        text = damaged(text, "cp1252")
    assert restored(spark, [text])[0].restored_text == "Übergröße für 7 Mäuse"


@pytest.mark.parametrize("page", ["cp1252", "mac_roman", "cp437", "cp850", "cp1251"])
def test_share_of_planted_damage_that_is_restored_exactly(spark, page) -> None:
    rng = random.Random(3)
    words = ["Jürgen’s", "señal", "mínima", "ATENÇÃO", "Âge", "l’été", "Größe", "café", "wheat", "25", "naïve", "Ночью", "было"]
    clean = [" ".join(rng.choices(words, k=12)) for _ in range(60)]
    got = restored(spark, clean + [damaged(t, page) for t in clean])
    right = sum(got[60 + i].restored_text == t for i, t in enumerate(clean) if 60 + i in got)
    assert right >= 0.95 * sum(not t.isascii() for t in clean) and not set(got) & set(range(60))


@given(st.text(alphabet="Ãâ€©™°Â�é", min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_search_against_all_paths(run: str) -> None:
    def every(i: int, state: str) -> list[tuple[float, str]]:
        if i == len(run):
            return [(0.0, "")]
        if run[i] == garbled.LOST:
            j = next((j for j in range(i, len(run)) if run[j] != garbled.LOST), len(run))
            steps = [(j, run[i:j], "", garbled.LOSS)]
        else:
            steps = [(i + 1, run[i], "", garbled.KEEP)]
            for no, p in enumerate(garbled.UTF8_MISREAD):
                steps += [(i + k, ch, p, garbled.read_cost(no, k, ch, lost)) for k, ch, lost in garbled._reads(run, i, p)]
        return [(c + d + (garbled.SWITCH if p and state not in ("", p) else 0.0), ch + t) for j, ch, p, c in steps for d, t in every(j, p or state)]

    best: dict[str, float] = {}
    for c, t in every(0, ""):
        best[t] = min(c, best.get(t, 1e9))
    want = sorted(best.values())[: garbled.BEST]
    got = garbled.viterbi(run, garbled.BEST)
    assert [round(c, 6) for c, *_ in got] == [round(c, 6) for c in want] and all(abs(best[t] - c) < 1e-6 for c, t, *_ in got)
