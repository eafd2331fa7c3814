"""Operators 4, 9 and 10 against plain Python."""

import base64
import bz2
import gzip
import hashlib
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from retrievo.llm import packing, pii, secret_scan
from tests.conftest import SF
from tests.llm.cases import ROWS, frame

SPACE = "\x20\x09-\x0d"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 - 9 * (d > 4) if i % 2 else d
        total += d
    return total % 10 == 0


def plain_pii(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"[^0-9]", "", m)) <= 19 and luhn(re.sub(r"[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
    }
    return sorted((m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m[0]))


def plain_secrets(text):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def long_case(text):
    return text is not None and len(text) > 20_000 and " " not in text  # the plain patterns are quadratic there


@pytest.mark.parametrize("table", ["cases", "documents"])
def test_base_spans_of_personal_data(spark, table):
    df = frame(spark) if table == "cases" else documents(spark)
    rows = pii.digest(pii.sanitise(df)).collect()
    want = sorted((str(r["doc_id"]), digest([] if long_case(r["text"]) else plain_pii(r["text"] or ""))) for r in df.collect())
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows) == want
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows) >= 4


TRICKY = [
    "a@b.c_x@d.e f@g h@i.j. k@l.m..n", "1.2.3.4.5.6.7.8 999.1.2.3 0001.2.3.000255 1.2.3", "4111-1111-1111-1111 41111111111111112222 5500 0000 0000 0004-1",
    "+1 (555) 010-9999. +49-30-1 ++12345678901 +1.2.3.4.5.6.7.8.9.0", "é@b.co 日本 me@x.org\nme@x.org,1.1.1.1", "0" * 50 + " " + "1 " * 30,
]


def test_tricky_personal_data(spark):
    df = frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(TRICKY)])
    got = {r["doc_id"]: r["base_sha256"] for r in pii.digest(pii.sanitise(df)).collect()}
    assert got == {i: digest(plain_pii(t)) for i, t in enumerate(TRICKY)}


def entity(text, span):
    value = text[span[0]:span[2]]
    return span[3], re.sub("[^0-9]", "", value) if span[3] in ("card", "phone") else value.lower()


def plain_spans(texts, generalise=0.8, remove=0.9):
    """Base and added spans of each text, every entity against every term."""
    words = [Counter({w.lower() for w in re.findall(r"[^\W_]+", t)}) for t in texts]
    n_t = sum(words, Counter())
    base = [plain_pii(t) for t in texts]
    entities = [{entity(t, s) for s in spans} for t, spans in zip(texts, base)]
    n_e = Counter(e for es in entities for e in es)
    terms = []
    for text, spans in zip(texts, base):
        found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)] if spans else []
        terms.append([t for t in found if not any(s[0] < t[1] and t[0] < s[2] for s in spans)])
    n_te = Counter(pair for es, ts in zip(entities, terms) for t in {t[2] for t in ts} for pair in ((e, t) for e in es))
    n = len(texts)

    def told(e, t):
        return round(math.log(n * n_te[e, t] / ((n_t[t] + 1) * n_e[e])) / math.log(n / n_e[e]), 9) if n_e[e] < n else 0

    out = []
    for spans, es, ts in zip(base, entities, terms):
        shares = {t[2]: max(told(e, t[2]) for e in es) for t in ts}
        added = [(t[0], 4, t[1], "remove" if shares[t[2]] >= remove else "generalise") for t in ts if shares[t[2]] >= generalise]
        out.append(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans + added)))
    return out


@pytest.mark.parametrize("table", ["cases", "documents", "shared"])
def test_added_spans_against_every_pair(spark, table):
    if table == "shared":  # entities in one, some and a third of the rows, alone, together and in copies
        pool = random.Random(7)
        texts = [" ".join(f"w{int(pool.paretovariate(0.6))}" for _ in range(12)) for _ in range(150)]
        texts = [t + f" hub@a.example k{i % 9}" * (i % 3 == 0) + f" u{i % 20}@b.example z{i % 20}" * (i % 4 == 0) for i, t in enumerate(texts)]
        df = frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts + texts[:30] + [texts[5]] * 20)])
    else:
        df = frame(spark) if table == "cases" else documents(spark)
        df = df.filter("text is null or length(text) <= 20000 or text like '% %'")
    rows = df.collect()
    want = plain_spans([r["text"] or "" for r in rows])
    got = [r["spans"] for r in pii.digest(pii.sanitise(df)).collect()]
    assert sorted(zip(want)) == sorted(zip(got))
    assert table == "cases" or any("remove" in s or "generalise" in s for s in got)  # so few rows show nothing for certain
    if table == "shared":
        assert any("generalise" in s for s in got) and any("remove" in s for s in got)


def test_disclosing_terms_anywhere_in_documents_with_entities_only(spark):
    far = "today and then contact " * 20
    rows = [(i, f"Zanzibar 1352 {far}bob@corp.example ab Zanzibar", "en", "a", 1) for i in range(6)]
    rows += [(100 + i, f"other text about contact and then today nothing {'ab' if i < 4 else ''}", "en", "a", 1) for i in range(60)]
    df = frame(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.sanitise(df)).collect()}
    text = rows[0][1]
    kinds = [(text[slice(*map(int, s.split(":")[1:]))], s.split(":")[0]) for s in got[0].split(",")]
    assert kinds == [("Zanzibar", "remove"), ("1352", "remove"), ("bob@corp.example", "email"), ("Zanzibar", "remove")]
    assert all(got[100 + i] == "" for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df, generalise=0.5, remove=0.95).collect()}
    assert clean[0] == f"<term> 1000 {far}<email> <term> <term>"
    assert clean[100] == rows[6][1]


def test_share_at_a_threshold_counts(spark):
    df = frame(spark, [(0, "x1 a@b.example", "en", "a", 1)] + [(i, "plain", "en", "a", 1) for i in range(1, 16)])
    share = 0.75  # log(16 / 2) / log(16)
    for generalise, remove, kind in [(share, 1, "generalise"), (0.5, share, "remove"), (share + 1e-8, 1, None)]:
        spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.sanitise(df, generalise=generalise, remove=remove)).collect()}[0]
        assert spans == (f"{kind}:0:2," if kind else "") + "email:3:14"


def test_sanitised_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark)).collect()}
    assert texts[3] == texts[4] == "" and texts[9] == ROWS[9][1] and len(texts) == len({r[0] for r in ROWS})
    assert all(f"<{kind}>" in texts[6] for kind in ("email", "phone", "card", "ip"))
    assert not plain_pii(texts[6])
    spans = pii.sanitised(frame(spark, [(1, "1.2.3.4.5.6.7.8 x@y.z\n+4930 1234567890", "en", "a", 1)])).collect()
    assert spans[0]["text"] == "<ip>.<ip> <email>\n<phone>"


@pytest.mark.parametrize("table", ["cases", "documents"])
def test_base_secrets(spark, table):
    df = frame(spark) if table == "cases" else documents(spark)
    rows = secret_scan.digest(secret_scan.scan(df)).collect()
    want = sorted((str(r["doc_id"]), digest(plain_secrets(r["text"] or ""))) for r in df.collect())
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows) == want
    for r in rows:
        assert len([s for s in r["spans"].split(",") if s]) >= r["n_assign"] + r["n_access"] + r["n_hex"]


def test_layers_of_encoding():
    secret = "password=hunter2hunter2"
    percent = "".join(f"%{b:02X}" for b in secret.encode())
    b64 = base64.b64encode(secret.encode()).decode()
    packed = base64.b64encode(gzip.compress(secret.encode())).decode()
    deflated = base64.b64encode(zlib.compress(secret.encode())).decode()
    twice = base64.b64encode(urllib.parse.quote(b64, safe="").encode() + b" tail").decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in secret)
    for token in (percent, b64, packed, deflated, twice, escaped):
        text = f"before it {token} and after"
        found = secret_scan.findings(text)
        assert len(found) == 1, token
        s, _, e, kind, layer, value = found[0]
        assert kind == "assign" and layer and value == "hunter2hunter2"
        assert text[s:e].strip() in token or token in text[s:e]
    assert secret_scan.findings("plain words 100% sure \\u0041 thndtindthereadthing") == []
    part = f"pass%77ord=hunter2hunter2 {secret}"
    assert [x[:4:2] for x in secret_scan.findings(part)] == [(0, 25), (26, 49)]


def test_an_encoded_secret_is_found_at_every_place(spark):
    b64 = base64.b64encode(b"password=hunter2hunter2").decode()
    alike = base64.b64encode(gzip.compress(b"password=hunter2hunter2")).decode()
    nested = base64.b64encode(f"see {b64} and {b64}".encode()).decode()
    percent = "%70assword=hunter2hunter2"
    text = f"a: {b64}\nb: {alike}\nc: {b64}\nd: {nested}\ne: {percent}\nf: {percent}\ng: {nested} %41"
    want = [m.span() for m in re.finditer("|".join(map(re.escape, (nested, alike, b64, percent))), text)]
    assert len(want) == 7 and [(s, e) for s, _, e, *_ in secret_scan.findings(text)] == want
    out = secret_scan.redact(frame(spark, [(1, text, "en", "a", len(text))])).first()["text"]
    assert out == "a: [SECRET]\nb: [SECRET]\nc: [SECRET]\nd: [SECRET]\ne: [SECRET]\nf: [SECRET]\ng: [SECRET] %41"


SECRET = b"some lines before password=hunter2hunter2 and some after it"


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress])
def test_streams_under_escapes_are_opened(pack):
    data = pack(SECRET)
    forms = ["".join(f"%{b:02x}" for b in data), urllib.parse.quote(data), "".join(f"\\x{b:02x}" for b in data), repr(data)[2:-1]]
    blob = base64.b64encode(b"\x00\xff\x07 blob " + data + b"\xfe\xff").decode()
    for token in (*forms, blob):
        text = f"before it {token} and after"
        assert [text[x[0] : x[2]] for x in secret_scan.findings(text)] == [token]
    if pack is not bz2.compress:  # which gives nothing of a block that is cut
        assert [x[3] for x in secret_scan.findings(base64.b64encode(data[:-9]).decode())] == ["assign"]


def test_wrapped_base64():
    for data in (SECRET * 2, gzip.compress(SECRET + bytes(range(256)))):
        for width, end in ((20, "\n"), (64, "\r\n"), (76, "\n  ")):
            b64 = base64.b64encode(data).decode()
            lines = end.join(b64[i : i + width] for i in range(0, len(b64), width))
            for text in (f"-----BEGIN-----\n{lines}\n-----END-----", f"here:{end}{lines}{end}The rest of it", lines):
                assert "hunter2hunter2" in {x[5] for x in secret_scan.findings(text)}, text
    assert secret_scan.findings("a_rather_long_word_in_prose\nand_another_long_word_there\nand short") == []


def test_layers_that_are_not_utf8_are_read():
    for data in (SECRET.decode().encode("utf-16"), SECRET.decode().encode("utf-16-be"), b"\xff\xfe\x81" * 40 + SECRET + b"\x00\x80", "é ü".encode("latin-1") + SECRET):
        for token in (base64.b64encode(data).decode(), "".join(f"%{b:02X}" for b in data)):
            assert [x[3] for x in secret_scan.findings(f"x {token} y")] == ["assign"], data


def test_large_streams_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(secret_scan, "MAX_LAYER", 1 << 16)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 10)
    for pack in (gzip.compress, zlib.compress, bz2.compress):
        for at in (0, 65_500, 65_536 - 30, 300_000):
            token = base64.b64encode(pack(b" " * at + SECRET + b" " * 200_000)).decode()
            assert [x[:3] for x in secret_scan.findings(f"x {token} y")] == [(2, 0, 2 + len(token))]


def test_fixpoint_of_self_similar_layers():
    assert secret_scan.findings("%2525252525252541" * 50) == []


def test_redaction(spark):
    df = frame(spark)
    out = {r["doc_id"]: r for r in secret_scan.redact(df).collect() if r["doc_id"] is not None}
    assert out[7]["text"] == "x [SECRET] y" or "[SECRET]" in out[7]["text"]
    assert "AbCdEf123456" not in out[7]["text"] and out[7]["n_chars"] == len(out[7]["text"])
    assert out[1]["text"] == ROWS[0][1] and out[3]["text"] is None


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert pii.digest(pii.sanitise(empty)).count() == 0
    assert secret_scan.digest(secret_scan.scan(empty)).count() == 0
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("table", ["cases", "documents"])
def test_packing_round_trip(spark, table):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    df = frame(spark) if table == "cases" else documents(spark)
    rows = packing.pack(df, keep_ids=True).collect()
    want = sorted((str(r["doc_id"]), tuple([*own.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in df.collect())
    docs = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        docs.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], tuple(ids)))
    got = []
    for (doc, n), parts in docs.items():
        copies = sum(1 for w in want if w[0] == doc and len(w[1]) == n)
        whole = sum((list(p) for _, p in sorted(parts)[::copies]), [])
        assert len(whole) == n
        got += [(doc, tuple(int(x) for x in whole))] * copies
    assert sorted(got) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    tokens = sum(r["length"] for r in rows)
    assert len(sequences) * 1024 <= tokens * 1.03 + 2048


def test_best_fit_takes_the_tightest_window():
    sequences, offsets, n = packing.best_fit([9, 8, 5, 2, 1, 1], 10)
    assert (sequences, offsets, n) == ([0, 1, 2, 1, 0, 2], [0, 0, 0, 8, 9, 5], 3)


def test_white_space_runs_match_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = packing.encoder(packing.default_ranks(), added=packing.default_added())
    for text in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\nc  <|endoftext", " <|endoftext|>  x", "a b", " a b ", "a  b", "a \n b", "a\n\nb c\n", "\n a", "a b c", "it's we'll 12 3,4", "中文 ü\tx", ""):
        assert np.frombuffer(ids(text), dtype="<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_cut_between_tokens(monkeypatch):
    words = ["a", "it's", "12", "中文", "é,", "...", "x\ty", "\n", "", " ", "\x1c", "\x85b", "'ll", "\u3000", "z\xa0"]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, n)) for n in (1, 7, 30, 400)]
    whole = packing.encoder(packing.default_ranks())
    want = [whole(text) for text in texts]
    for size in (1, 2, 5, 50):
        monkeypatch.setattr(packing, "LONG", size)
        assert [whole(text) for text in texts] == want


def test_added_tokens_and_repeated_rows_when_packed(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    text = "an end <|endoftext|> in a text" + " and more" * 3000
    rows = [(None, text, "en", "a", 1)] * 4 + [(i, "short <|endoftext|>", "en", "a", 1) for i in range(50)] + [(None, "none", "en", "a", 1)] * 200
    got = packing.pack(frame(spark, rows), keep_ids=True, group_pieces=16).collect()
    long = [r for r in got if r["doc_tokens"] > 100]
    want = np.array([*own.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
    assert 50256 in want
    assert Counter((r["start"], bytes(r["ids"])) for r in long) == Counter({(i, want[i : i + 1024].tobytes()): 4 for i in range(0, len(want), 1024)})
    assert len({r["sequence_id"] for r in long if r["length"] == 1024}) == 4 * (len(want) // 1024)
    lots = Counter(r["sequence_id"] >> 40 for r in got if r["length"] < 1024)
    assert len(lots) >= 10 and max(lots.values()) < 60
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_letters_whose_lower_case_is_longer(spark):
    texts = [f"İzmir{i} word{i} mail a{i}@b.com" for i in range(3)] + ["filler"] * 60
    got = [r["spans"] for r in pii.digest(pii.sanitise(frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]))).orderBy("doc_id").collect()]
    assert got == plain_spans(texts)
    assert all("generalise:0:6" in s and "generalise:7:12" in s for s in got[:3])


def test_many_findings_and_long_texts_take_linear_room():
    import time
    import tracemalloc

    def seconds(n):
        text = " ".join(base64.b64encode(f"password = 'AbCdEf{i:09d}'".encode()).decode() for i in range(n))
        began = time.time()
        assert len(secret_scan.findings(text)) == n
        return time.time() - began

    assert seconds(8000) < 8 * max(seconds(2000), 0.05)
    text = "word and " * 200_000 + "%20 token%3A zzzzzzzz9"
    tracemalloc.start()
    found = secret_scan.findings(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [text[x[0] : x[2]] for x in found] == ["token%3A zzzzzzzz9"]
    assert peak < 8 * len(text)


def test_places_of_layers_in_layers():
    text = "ab%2541c%25%34%31 %5Cu0041x" * 3
    layer, places, mapped = text, None, [(i, i + 1) for i in range(len(text))]
    for pattern, decode in ((secret_scan.URL, secret_scan._percent), (secret_scan.URL, secret_scan._percent), (secret_scan.UNICODE, secret_scan._escape)):
        out, spans, at = [], [], 0
        for m in pattern.finditer(layer):  # a list of places, a character at a time
            new = decode(m[0])
            spans += mapped[at : m.start()] + [(mapped[m.start()][0], mapped[m.end() - 1][1])] * len(new)
            at = m.end()
        spans += mapped[at:]
        layer, step = secret_scan._rewritten(layer, pattern, decode)
        places, mapped = step.over(places) if places else step, spans
        assert len(mapped) == len(layer) == places.size
        assert all(places.span(i, j) == (mapped[i][0], mapped[j - 1][1]) for i in range(len(layer)) for j in range(i + 1, len(layer) + 1))
