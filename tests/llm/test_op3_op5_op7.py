"""SentencePiece lattice, template decontamination and SimHash against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevo.llm import op3_sentencepiece as op3
from relevo.llm import op5_decontaminate as op5
from relevo.llm import op7_simhash as op7

# -------------------------------------------------------------- SentencePiece

TEXTS = ["Hello  world\n x\ty", " lead", "trail   ", "", None, "ﬁ①é日本𝔘 ①①", "<s>a</s><unk>", "a▁b", "a\r\nb\x00c", "The quick brown fox, isn't it? 123.45",
         "x" * 3000, "supercalifragilistic " * 3, "w " * 5000, " ", "Überraschung für señor ção"]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path(op3.MODEL)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "e", "u") for i, t in enumerate(texts)], "doc_id long, text string, n int, edges string, unit string")


@pytest.mark.parametrize("max_units", [op3.MAX_UNITS, 3, 0])
def test_ids_equal_the_library_and_decode(spark, path, max_units):
    lib = op3.model_of(path).lib
    got = {r.doc_id: r for r in op3.decode(op3.encode(docs(spark, TEXTS), path, max_units), path).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert list(got[i].ids) == lib.encode(t or ""), t
        assert got[i].decoded == (t or "").replace("▁", " ")


def unigram_path(tmp_path, path):
    """The model file with its type set to unigram: the library then runs Viterbi over the same pieces."""
    with open(path, "rb") as f:
        data = f.read()
    at = data.index(b"\x18\x02 \x80\xfa\x01")  # model_type BPE, then the vocabulary size
    out = tmp_path / "unigram.model"
    out.write_bytes(data[:at + 1] + b"\x01" + data[at + 2:])
    return str(out)


def test_viterbi_of_a_unigram_model(spark, path, tmp_path):
    uni = unigram_path(tmp_path, path)
    model = op3.model_of(uni)
    assert model.kind == op3.UNIGRAM and op3.model_of(path).kind == op3.BPE
    texts = [t for t in TEXTS if t and "  " not in t and not t.endswith(" ") and "①" not in t and "▁" not in t and len(t) < 3000]
    unit = spark.createDataFrame([(u,) for u in {" " + w for t in texts for w in t.split(" ") if w}], "unit string")
    ids = {r.unit: list(r.ids) for r in op3.unit_ids(spark, unit, model).collect()}
    score = lambda x: sum(model.lib.get_score(i) for i in x)
    for u, got in ids.items():
        want = model.lib.encode(u[1:])
        if not any(model.lib.is_byte(i) for i in want):
            assert got == want or score(got) == score(want), u
        assert model.lib.decode(got) == u[1:].replace("▁", " ")


def test_units_are_bounded_by_count(spark):
    df = docs(spark, ["a a a b b c", "a b d"])
    assert {r.unit for r in op3.count_units(df, 2).collect()} == {" a", " b"}
    assert {r.unit for r in op3.count_units(df, 3).collect()} == {" a", " b"}  # c and d occur alike
    assert op3.count_units(df, 0).collect() == []


def test_no_texts(spark, path):
    assert op3.encode(docs(spark, []), path).collect() == []


# ------------------------------------------------------------ decontamination


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, h string")


def pages(spark, rows):
    return spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, item_id int, containment string")


QUESTION = "A farmer called Anna Miller owns 12 sheep and sells 5 sheep to Bob for 30 dollars each at the yearly market. Later Anna buys 5 goats and walks home 7 km with Bob."
AGAIN = QUESTION.replace("Anna", "Maria").replace("Miller", "Silva").replace("Bob", "Tom").replace("12", "40").replace("5", "8").replace("30", "99").replace("7 km", "3 km")
MIXED = QUESTION.replace("Anna", "Maria", 1).replace("Bob", "Tom", 1).replace("5", "8", 1).replace("sells 8", "sells 6")
PROSE = "In the morning the farmer went to the market and sold some sheep, then the long road home was quiet and the hills were green and wide as ever before."


def test_copies_and_new_parameters_are_found(spark):
    rows = [(1, f"some words before {QUESTION} and after"), (2, f"Intro text.\n{AGAIN}\nMore."), (3, PROSE), (4, None), (5, ""), (6, QUESTION[:70]), (7, AGAIN.upper())]
    got = {r.doc_id: r for r in op5.contaminated(pages(spark, rows), items(spark, [(9, QUESTION), (8, "too short"), (7, None)])).collect()}
    assert set(got) - {7} == {1, 2} and got[1].item_id == 9 and got[2].consistency == 1.0 and got[1].containment >= 0.9


def test_inconsistent_slots_are_another_text(spark):
    values = iter(str(x) for x in range(100, 200))
    text = "the box holds 5 red balls and 5 blue balls while 5 more green balls and 5 white balls lie near the door with 5 old bats"
    other = re.sub("5", lambda m: next(values), text)
    same = text.replace("5", "77")
    got = op5.contaminated(pages(spark, [(1, other), (2, same)]), items(spark, [(1, text)])).collect()
    assert [(r.doc_id, r.consistency) for r in got] == [(2, 1.0)]


BOXES = "Anna packs a box that holds 12 red balls. Later Ben packs a box that holds 30 red balls. How many balls are there?"


def test_repeated_templates_face_themselves(spark):
    again = BOXES.replace("Ben", "Tom").replace("12", "7").replace("30", "9")
    other = BOXES.replace("12", "4").replace("30", "5")
    split = BOXES.replace("Later", "Much later, I was told,")
    rows = [(1, BOXES), (2, f"{BOXES}\n{again}"), (3, f"{other}\n{again}\n{BOXES}"), (4, split), (5, PROSE)]
    got = op5.contaminated(pages(spark, rows), items(spark, [(1, BOXES)])).collect()
    found = {r.doc_id: r.consistency for r in got}
    assert found[1] == found[2] == found[3] == 1.0 and 5 not in found


def brute_words(text):
    """Template words, in plain Python."""
    t = text or ""
    t = re.sub(r"(?<=[0-9]) ?((?i:" + "|".join(sorted(map(re.escape, op5.UNITS), key=len, reverse=True)) + r"))(?![^\W\d_]|\d)", f" {op5.UNIT} ", t)
    t = re.sub(r"[0-9]+(?:[.,:/][0-9]+)*", f" {op5.NUMBER} ", t)
    t = re.sub(rf"(?<=[^\W_,;:'] |[,;:'{op5.SLOTS}] )[A-ZÉÜ][^\W\d_'-]*(?:['-][^\W\d_]*)*", f"{op5.NAME} ", t)
    return [w for w in re.split(rf"[^a-zéüñßçàèêôûäöíóáúÀ-ÿ{op5.SLOTS}]+", t.lower()) if w]


def test_containment_equals_brute_force(spark):
    r = random.Random(1)
    vocab = [f"{a}{b}" for a in "bcdfg" for b in ("an", "er", "ol", "ut", "é")]
    bench = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(4, 25)))) for i in range(12)]
    rows = []
    for d in range(60):
        w = [r.choice(vocab) for _ in range(30)]
        if d % 3 == 0:
            q = r.choice(bench)[1].split()
            w[5:5] = q[r.randint(0, 2):len(q) - r.randint(0, 3)]
        rows.append((d, " ".join(w)))
    wins = lambda t: {tuple(w[i:i + 5]) for w in [brute_words(t)] for i in range(len(w) - 4)}
    want = {(d, i) for d, t in rows for i, q in bench if wins(q) and len(wins(q) & wins(t)) >= 0.8 * len(wins(q))}
    got = {(x.doc_id, x.item_id) for x in op5.contaminated(pages(spark, rows), items(spark, bench)).collect()}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("bound", ["MAX_BROADCAST_WINDOWS", "MAX_BROADCAST_KEYS"])
def test_beyond_broadcast_bounds(spark, monkeypatch, bound):
    monkeypatch.setattr(op5, bound, 0)
    got = op5.contaminated(pages(spark, [(1, AGAIN), (None, QUESTION), (3, PROSE)]), items(spark, [(9, QUESTION)])).collect()
    assert {r.doc_id for r in got} == {1, None}


def test_empty_sides_and_long_text(spark):
    assert op5.contaminated(pages(spark, []), items(spark, [(1, QUESTION)])).collect() == []
    assert op5.contaminated(pages(spark, [(1, QUESTION)]), items(spark, [])).collect() == []
    long = "aa bb cc " * 60_000 + QUESTION + " dd ee" * 60_000
    assert [r.doc_id for r in op5.contaminated(pages(spark, [(1, long), (1, PROSE)]), items(spark, [(1, QUESTION)])).collect()] == [1]


# -------------------------------------------------------------------- SimHash


def report(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "r", 0, 1) for d, t in rows], "doc_id long, text string, range string, rn int, fp int")
    return op7.fingerprint_report(df, **kw).collect()


def random_rows(n=40, seed=1):
    r = random.Random(seed)
    rows = [(3 * i, " ".join("".join(r.choice("abcdé𝔘") for _ in range(r.randint(1, 8))) for _ in range(r.randint(0, 60)))) for i in range(n)]
    return rows + [(1000, None), (1001, "x"), (1002, rows[3][1]), (1003, rows[3][1] + " tail")]


def edited(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    out = {}
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 4
        out[d] = (len(t), hashlib.sha256((t[:len(t) - k] + nxt[:k]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("range_rows", [1000, 3])
def test_edited_texts_equal_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(op7, "RANGE_ROWS", range_rows)
    rows = random_rows()
    got = report(spark, rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == edited(rows) and len(got) == len(rows)
    fp = {r.doc_id: r.fingerprint for r in got}
    assert fp[9] == fp[1002] and fp[1000] == "0" * 16 and all(re.fullmatch("[0-9a-f]{16}", x) for x in fp.values())
    order = sorted(fp)
    for r in got:
        nxt = order[(order.index(r.doc_id) + 1) % len(order)]
        like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
        assert r.near_next == like(r.fingerprint, fp[nxt]) and r.near_edited == like(r.fingerprint, r.edited_fingerprint)


def test_fingerprint_is_the_weighted_vote(spark):
    text = "one two three two three four"
    df = spark.createDataFrame([(1, text)], "k int, text string")
    fp = op7.fingerprints(df, ["k"]).first().fp & (1 << 64) - 1
    w = text.split()
    pairs = list(zip(w, w[1:] + [None], strict=True))
    hashes = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b").alias("h")).collect()
    for bit in range(64):
        votes = sum((len(a) + len(b or "")) * (1 if h.h >> bit & 1 else -1) for (a, b), h in zip(pairs, hashes, strict=True))
        assert (fp >> bit & 1) == (votes > 0)


def test_search_equals_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = base + [b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(12)] + base[:2]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {x.fp: x.near for x in op7.within_radius(df, df).collect()}
    assert got == {signed(x): sum(bin(x ^ y).count("1") <= 3 for y in fps) for x in fps}
    with pytest.raises(ValueError):
        op7.within_radius(df, df, 4)


def test_ties_nulls_one_row_and_no_rows(spark):
    got = report(spark, [(None, "n n n n"), (5, "bbbb"), (5, "aaaa"), (5, "aaaa")])
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in ("n n n a"[:6] + "a", "aaaa", "aaab", "bbbn"))
    one = report(spark, [(1, "abcdefgh")])
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    assert report(spark, []) == []


def test_long_text_votes_do_not_overflow(spark):
    got = report(spark, [(50, "word other " * 200_000), (100, "word other " * 200_000), (101, "q")])
    fp = {r.doc_id: r for r in got}
    assert fp[50].fingerprint == fp[100].fingerprint and fp[50].n_near == 1 and fp[101].n_near is None


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1], dtype="<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0")


def test_sentencepiece_stage_gives_ids_and_text(spark, path):
    lib = op3.model_of(path).lib
    got = {r.doc_id: r for r in op3.sentencepiece_stage(spark, docs(spark, TEXTS), "").collect()}
    for i, t in enumerate(TEXTS):
        assert list(got[i].ids) == lib.encode(t or "") and got[i].n_tokens == len(got[i].ids)
        assert got[i].text == (t or "").replace("▁", " ")
