"""Periodic runs against brute force, in core and through Spark."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relevo.llm import op11_periodic_runs as op11

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of all runs: maximal stretches per period, at their smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def collapsed(words, runs):
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def core(texts):
    """Runs per text from the numpy core."""
    ids = {}
    h, first = [], [0]
    for t in texts:
        h += [ids.setdefault(w, len(ids)) for w in t]
        first.append(len(h))
    table = np.random.default_rng(0).integers(1, 1 << 63, size=len(ids) + 1, dtype=np.uint64)
    s, e, q = op11.runs_of(table[np.array(h, dtype=np.int64)] if h else np.empty(0, dtype=np.uint64), np.array(first))
    doc = np.searchsorted(first, s, side="right") - 1
    out = [[] for _ in texts]
    for d, a, z, p in zip(doc, s, e, q, strict=True):
        out[d].append((int(a - first[d]), int(z - a), int(p)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40).map("".join), max_size=5))
def test_small_alphabets(texts):
    assert core(texts) == [brute(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcd", min_size=1, max_size=6), st.integers(1, 9)), max_size=8), st.integers(1, 4))
def test_repeated_phrases(parts, again):
    text = "".join(p * k for p, k in parts) * again
    assert core([text, text + "e", "e" + text]) == [brute(t) for t in (text, text + "e", "e" + text)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_structured_and_long_texts(monkeypatch):
    r = random.Random(2)
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(600))
    texts = ["a" * 500, "ab" * 300, thue, fibonacci(700), "".join(r.choice("ab") for _ in range(800)), ("abcabd" * 9 + "e") * 12,
             "".join(r.choice("abcdefgh") for _ in range(200)) * 5, "aab" * 50 + "aaab" * 50, ""]
    want = [brute(t) for t in texts]
    assert core(texts) == want
    monkeypatch.setattr(op11, "CHUNK", 37)
    assert core(texts) == want


def test_a_grammar_spells_its_text():
    """Rules and what is left cover the text; equal rules stand for equal words."""
    r = random.Random(4)
    text = "".join(r.choice("abc") for _ in range(300)) + "abcabc" * 20
    sym = np.array([ord(c) - 97 for c in text])
    rules, places, left = op11.re_pair(sym, np.zeros(len(text), dtype=np.int64))
    spell = [text[a:z] for a, _, z in zip(*rules, strict=True)]
    assert all(a < b < z for a, b, z in zip(*rules, strict=True))
    for k, at in zip(*places, strict=True):
        assert text[at:at + len(spell[k])] == spell[k]
    assert min(np.bincount(places[0])) >= 2
    assert "".join(text[a:z] for _, a, z in zip(*left, strict=True)) == text and len(left[0]) < len(text) / 2


def test_a_long_run_takes_linear_work():
    n = 400_000
    assert core(["ab" * (n // 2)]) == [[(0, n, 2)]]


SCHEMA = "doc_id long, text string, runs int, collapsed string, n_words string"


def made_periodic(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_rows(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["a", "b", "é", "日本", "x y"]) for _ in range(r.randrange(60))) + r.choice(["", "\n \t", "\xa0z"])) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "q"), (1004, "la " * 9), (1005, "x" * 100000 + " y" * 50000), (1004, "la " * 9), (1006, "no \x0bno\x0cno\rno no no")]
    spark.createDataFrame([(i, t, 1, "z", "z") for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        words = made_periodic(i, WORD.findall(t or ""))
        runs = brute(words) if len(words) < 10000 else [(1, 50000, 1)]
        s, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[i] = (len(runs), s, length, q, 1000 * length // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(words, runs)))
    assert {g.doc_id: tuple(g)[1:] for g in got} == want
    assert any(made_periodic(i, WORD.findall(t or "")) != WORD.findall(t or "") for i, t in rows)


def test_other_columns_null_ids_and_no_rows(spark):
    d = spark.createDataFrame([(None, "hi " * 8 + "end", 1, "c", "n"), (3, None, 2, "c", "n")], SCHEMA).withColumnRenamed("text", "body")
    got = {r.doc_id: r for r in op11.periodic_runs(d.withColumnRenamed("doc_id", "doc_id"), "body").collect()}
    assert [tuple(x) for x in got[None].runs] == [(0, 8, 1)] and got[None].collapsed == "hi end" and got[None].n_words == 9
    assert got[3].runs == [] and got[3].collapsed == "" and got[3].n_words == 0 and got[3].body is None
    assert op11.periodic_runs(d.limit(0), "body").collect() == []


@pytest.mark.parametrize("k", [0, 1])
def test_words_that_share_a_hash_are_told_apart(monkeypatch, k):
    import pyarrow as pa

    from relevo.llm import words
    real, calls = words.Words.hashes, []

    def weak(self, seed):
        calls.append(seed)
        return real(self, seed) % np.uint64(2) if len(calls) <= k else real(self, seed)
    monkeypatch.setattr(words.Words, "hashes", weak)
    w = words.words_of(pa.array(["a b c d e f g h i j a b a b a b a b"]))
    s, e, q = op11._checked_runs(w)
    assert list(zip(s, e, q, strict=True)) == [(10, 18, 2)]
