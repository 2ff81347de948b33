"""Substring dedup and MinHash components against brute force, and their edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from relevo.llm import op2_substring_dedup as op2
from relevo.llm import op8_minhash_dedup as op8
from relevo.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, h1 long, key string, component string, text_hash string, least int, pos int"
    return spark.createDataFrame([(d, t, "en", 1, "k", "c", "x", 2, 3) for d, t in rows], schema)


def corpus(seed=5, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[r.choice(vocab) for _ in range(30)] for _ in range(3)]
    rows = []
    for d in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(0, 80))]
        if d % 4 == 0:
            words[10:10] = r.choice(passages)[r.randint(0, 5):]
        rows.append((d, " ".join(words)))
    rows += [(100 + i, rows[7][1] + "\t tail") for i in range(5)] + [(200 + i, rows[9][1]) for i in range(5)]
    rows += [(300, " ".join(["same"] * 60)), (301, "x " + " ".join(["same"] * 40)), (302, None), (303, ""), (304, " \n "), (305, "ünï çödé " * 20), (306, "ünï çödé " * 20)]
    return rows


def removed(rows, window=13):
    first = {}
    ws = {d: WORD.findall(t or "") for d, t in rows}
    for d, w in ws.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in ws.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def digest(df):
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("k"))


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.k) for r in digest(op2.dedup_substrings(frame(spark, rows))).collect()}
    assert got == removed(rows)
    assert sum(v[1] for v in got.values()) > 300


def test_sketch_never_loses_a_window_when_it_is_full(spark, monkeypatch):
    monkeypatch.setattr(op2, "n_cells", lambda chars: 1 << 16)
    rows = corpus(6, 90)
    got = {r.doc_id: (r.n_words, r.n_removed, r.k) for r in digest(op2.dedup_substrings(frame(spark, rows))).collect()}
    assert got == removed(rows)


def test_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(op2, "MAX_BROADCAST_COPIES", 0)
    rows = corpus(7, 30)
    got = {r.doc_id: (r.n_words, r.n_removed, r.k) for r in digest(op2.dedup_substrings(frame(spark, rows))).collect()}
    assert got == removed(rows)


def test_substring_dedup_null_and_repeated_ids(spark):
    text = " ".join(f"a{i}" for i in range(20))
    other = " ".join(f"b{i}" for i in range(20))
    got = digest(op2.dedup_substrings(frame(spark, [(None, text), (5, text), (5, other), (6, other), (6, other), (None, None)]))).collect()
    count = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in got)
    assert count == [(False, 5, 20, 0), (False, 5, 20, 0), (False, 6, 20, 20), (False, 6, 20, 20), (True, 0, 0, 0), (True, 0, 20, 0)]


@pytest.mark.parametrize("run", [op2.dedup_substrings, op8.minhash_components])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).collect() == []


def test_one_very_long_text(spark):
    long = " ".join(f"w{i % 9973}" for i in range(400_000))
    got = {r.doc_id: r for r in op2.dedup_substrings(frame(spark, [(1, long), (2, "head " + long[:400_000])])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= got[2].n_words - 14 and got[1].n_words == 400_000


def shingles(text, k=2):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k=2):
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"W{i}" if i % 3 else f"é{i}" for i in range(400)]
    rows, d = [], 0
    for group in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 4, 12, 60, 200]))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(vocab)
            if group % 2:
                base = w  # chains: only neighbours are alike
            rows.append((d, " ".join(w)))
            d += 1
    rows += [(900, "a b c d e"), (901, "A  b\nC d E"), (902, None), (903, ""), (904, "one"), (905, "ONE"), (906, "  ")]
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_components_equal_brute_force(spark, seed):
    rows = near_corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8.minhash_components(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_stars_find_links_between_leaves(spark, monkeypatch):
    monkeypatch.setattr(op8, "FEW_PAIRS", 0)
    rows = near_corpus(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8.minhash_components(frame(spark, rows)).collect()}
    assert got == classes(rows)


def loose_group(n, seed=2):
    """Documents of likeness 0.6 that meet in buckets of hundreds; each is linked (0.85) with its partner alone."""
    r = random.Random(seed)
    rows = []
    for d in range(0, n, 2):
        at = r.sample(range(1, 98, 3), 8)
        for k in (0, 1):
            words = [f"w{i}" for i in range(100)]
            for x in at[:6] if k else at[2:]:
                words[x] = f"own{d}_{x}"
            rows.append((d + k, " ".join(words)))
    return rows


def test_links_between_leaves_of_a_large_loose_group(spark):
    rows = loose_group(3000)
    a, b, c = (shingles(rows[i][1]) for i in (0, 1, 2))
    assert 0.8 <= len(a & b) / len(a | b) < 0.9 and len(a & c) / len(a | c) < 0.7
    got = {r.doc_id: r.component_id for r in op8.minhash_components(frame(spark, rows)).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_blocks_of_a_hot_shingle(spark, monkeypatch):
    monkeypatch.setattr(op8, "FEW_PAIRS", 0)
    monkeypatch.setattr(op8, "MORE_CENTRES", 1)
    monkeypatch.setattr(op8, "BLOCK", 3)
    rows = near_corpus(9) + [(2000 + d, t) for d, t in loose_group(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8.minhash_components(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_minhash_null_and_repeated_ids(spark):
    got = op8.minhash_components(frame(spark, [(None, "a b c"), (7, "a b c"), (7, "a b c"), (8, "x y z"), (3, "x y z"), (7, "x y z")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (3, 3), (7, 3), (7, 3), (7, 3), (8, 3)]


def test_dedup_stage_keeps_columns_and_smallest(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, None), (4, ""), (5, "q r s t u v")]
    docs = frame(spark, rows)
    out = op8.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_members_of_a_group_of_near_copies_have_few_pairs(spark, monkeypatch):
    r, made, real = random.Random(3), [], op8.materialize
    base = [f"w{i}" for i in range(150)]
    rows = [(d, " ".join(w if r.random() > .01 else f"x{r.randrange(10**9)}" for w in base)) for d in range(200)]

    def counted(df, name):
        out = real(df, name)
        made.extend([out.count()] if name == "minhash-pairs" else [])
        return out
    monkeypatch.setattr(op8, "materialize", counted)
    got = {x.component_id for x in op8.minhash_components(frame(spark, rows)).collect()}
    assert got == {0} and made[0] < 6 * len(rows)


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    from relevo.llm import components as cc
    written = []
    monkeypatch.setattr(cc, "materialize", lambda df, name: (written.append(name), df.persist())[1])
    got = {tuple(r) for r in components(spark.createDataFrame([(1, 5), (7, 1), (2, 3), (None, 4), (6, 6)], "a long, b long")).collect()}
    assert got == {(1, 1), (5, 1), (7, 1), (2, 2), (3, 2)} and len(written) == 1
    written.clear()
    got = {tuple(r) for r in components(spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(1, 10)} and len(written) > 1


def test_few_pairs_are_confirmed_without_a_table_of_their_ends(spark, monkeypatch):
    written = []
    blob = lambda *x: bytearray(b"".join(i.to_bytes(8, "little") for i in x))
    sets = spark.createDataFrame([(1, blob(1, 2, 3)), (2, blob(1, 2, 3)), (3, blob(3, 4, 5))], "doc_id long, shingles binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    monkeypatch.setattr(op8, "materialize", lambda df, name: (written.append(name), df.persist())[1])
    assert [tuple(r) for r in op8.confirmed(pairs, sets).collect()] == [(1, 2)] and not written
    monkeypatch.setattr(op8, "MAX_BROADCAST_IDS", 1)
    assert [tuple(r) for r in op8.confirmed(pairs, sets).collect()] == [(1, 2)] and len(written) == 2
