"""WARC, personal data and packed ids: brute force, exact round trips, edge cases."""

import base64
import gzip
import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relevo.llm import op6_token_pack as op6
from relevo.llm import op9_warc as op9
from relevo.llm import op10_pii as op10

# ------------------------------------------------------------------------ WARC


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "x", 9) for p, u, h in rows], "page_id long, url string, html string, payload_digest string, original int")


def test_archives_round_trip(spark, tmp_path):
    odd = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n日本</p>\x00 " * 50
    rows = [(3, "http://a/ b\r\nX: y", odd), (1, None, odd), (2, "u", None), (9, "u", ""), (5, "u", "lone"), (None, "u", odd), (7, "u", odd), (7, "u", odd)]
    path = str(tmp_path / "warc")
    op9.write_archives(op9.resolve_revisits(op9.headers(pages(spark, rows))), path, records_per_file=3)
    got = op9.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    first = {odd: 1, "": 2, "lone": 5}
    for r in got:
        html = next((h or "") for p, _, h in rows if p == r.page_id)
        raw = html.encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        same = r.page_id == first[html]
        assert (r.record_type, r.refers_to) == (("response", None) if same else ("revisit", first[html]))
        assert r.payload == (raw if same else None)
    assert all("\n" not in r.url for r in got)


def test_archives_are_plain_warc(spark, tmp_path):
    path = tmp_path / "warc"
    op9.write_archives(op9.resolve_revisits(op9.headers(pages(spark, [(1, "http://x", "a"), (2, "http://y", "a")]))), str(path))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(path.glob("*.gz")))
    assert raw.count(b"WARC/1.1\r\n") == 2 and raw.endswith(b"\r\n\r\n")
    heads = [h for h, _ in op9.parse(io.BytesIO(raw))]
    assert {h["warc-type"] for h in heads} == {"response", "revisit"}
    ids = {h["warc-type"]: h for h in heads}
    assert ids["revisit"]["warc-refers-to"] == ids["response"]["warc-record-id"] and ids["revisit"]["warc-profile"] == op9.PROFILE


def test_small_payloads_are_all_responses(spark):
    got = op9.resolve_revisits(op9.headers(pages(spark, [(1, "", "ab"), (2, "", "ab"), (3, "", "abcd"), (4, "", "abcd")])), min_bytes=3).collect()
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_repeated_digests_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(op9, "MAX_BROADCAST_DIGESTS", 0)
    got = op9.resolve_revisits(op9.headers(pages(spark, [(2, "", "ab"), (1, "", "ab"), (None, "", "q")]))).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: 1, None: None}


def test_broken_archive_is_refused():
    with pytest.raises(ValueError):
        list(op9.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(op9.parse(io.BytesIO(b"junk\r\n")))


def test_no_pages(spark, tmp_path):
    op9.write_archives(op9.resolve_revisits(op9.headers(pages(spark, []))), str(tmp_path / "w"))
    assert op9.read_archives(spark, str(tmp_path / "w")).collect() == []


# --------------------------------------------------------------- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pat in BASE.items():
        for m in re.finditer(pat, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [None, "", "no data", "mail a.b+c@x-y.example.com, é𝔘 then d@e.f_g@h.i.", "1.2.3.4 and 256.1.1.1 and 001.002.003.0255 1.2.3.4.5.6.7.8 and 99999999999999999999999999999999999999999.1.1.1",
         "card 4337166598464399, 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (988) 555-2485 or +49 30 1234567 or +12 or +1234567890123456",
         "\u0001a@b.c\u0001 \u0003", "9" * 30_000, "a@b" + ".c" * 20_000, "+1" + " 2" * 20_000, "1 " * 40_000 + "x@y.z", "word " * 100_000 + "q@r.st",
         "order 4111111111111111; visa 4111111111111111"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "pii?", "v") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, pii string, value string")


def test_base_spans_equal_python(spark):
    got = op10.pii_report(docs(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = base_spans(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), TEXTS[r.doc_id][:60]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in BASE)
        assert [s for s in r.spans.split(",") if s.split(":")[0] in BASE] == want


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 here", "GB82 WEST 1234 5698 7654 33", "my ssn 123-45-6789", "it is 123-45-6789", "tax 000-45-6789", "DE89370400440532013000", "order AB12 3456 7890 1234"]
    got = {r.doc_id: r.spans for r in op10.pii_report(docs(spark, texts)).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "ssn:7:18", 3: "", 4: "", 5: "iban:0:22", 6: ""}


def test_context_moves_scores(spark):
    r = op10.pii_report(docs(spark, [TEXTS[-1]])).first()
    assert r.n_card == 2 and [float(x) for x in r.scores.split(",")] == [0.5, 0.8]


def test_redaction(spark):
    d = docs(spark, ["x a@b.cd y +1 (988) 555-2485", None, "clean", "1.2.3.4"])
    got = {r.doc_id: r for r in op10.pii_stage(spark, d, "").collect()}
    assert [got[i].text for i in range(4)] == ["x <email> y <phone>", None, "clean", "<ip>"]
    assert [got[i].n_chars for i in range(4)] == [19, 0, 5, 4] and op10.pii_stage(spark, d, "").columns == d.columns


def test_pii_empty_table(spark):
    assert op10.pii_report(docs(spark, [])).collect() == []


# ------------------------------------------------------------------ packed ids


@given(st.integers(1, 32), st.data())
@settings(max_examples=40, deadline=None)
def test_packing_round_trip(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2 ** width - 1), max_size=80)), dtype=np.uint32)
    raw = op6.pack(ids, width)
    assert len(raw) == (len(ids) * width + 7) // 8
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert op6.unpack(raw, width, a, b).tolist() == ids[a:b].tolist()


def test_width_and_range():
    assert [op6.bit_width(v) for v in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        op6.pack(np.array([8]), 3)


def token_texts():
    return ["Hello world, it's 1st!  two\n\n three", None, "", " ", "a<|endoftext|>b", "déjà vu ñ ß", "日本語 text x", "tab\t\tend  ", "\x1c\x85 odd", "x" * 5000, "a b " * 30_000, "don't 've 12 3", "a_b__c ~~ ²½"]


def test_packed_files_equal_the_library(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(op6.TOKENIZER)
    lib = Tokenizer.from_file(path)
    texts = token_texts()
    rows = [(7 * (len(texts) - i), t, 1, "f") for i, t in enumerate(texts)] + [(None, "null id", 1, "f"), (7, "zz repeated id", 1, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, file string").repartition(3)
    out = str(tmp_path / "ids")
    op6.write_packed(df, out, path, lib.get_vocab_size(), block_ids=500)
    got = op6.read_packed(spark, out).collect()
    start = 0
    want = []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: x[1]) == want


def test_no_documents(spark, tmp_path):
    import public_tokenizers

    df = spark.createDataFrame([], "doc_id long, text string")
    op6.write_packed(df, str(tmp_path / "e"), public_tokenizers.path(op6.TOKENIZER), 50_257)
    assert op6.read_packed(spark, str(tmp_path / "e")).collect() == []


def test_long_runs_take_linear_time(spark):
    import time
    text = "b" * 1_000_000 + " x@y.zz " + "1" * 1_000_000 + " a@b.c.d@e.fr x@y.z%w@q.r 1.2.3.4.5.6.7.8 " + "+" * 1000
    began = time.time()
    r = op10.find_pii(spark.createDataFrame([(text,)], "text string")).first().pii
    assert time.time() - began < 20
    tail = text[1_000_000:1_000_008] + text[2_000_008:]
    want = [m.group() for m in re.finditer(BASE["email"], tail)]
    assert [s.value for s in r.email] == want and [s.value for s in r.ip] == ["1.2.3.4", "5.6.7.8"]
