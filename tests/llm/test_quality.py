"""Languages, secrets, quality model and quality rules."""

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import tracemalloc
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest

from stitchwork.llm import language_id, quality_model, quality_rules, queries, secret_scan


# ---- language -------------------------------------------------------------------------------

def _phrases(text, learned):
    """Longest matches, found by searching the text itself."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at:at + n] in learned:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def test_automaton_parses_like_a_search(corpus, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 100)
    texts = list(corpus.values())
    learned = {"a": texts[0][:700], "b": texts[1][:500], "c": texts[2][:900]}
    known = language_id.Parser(learned)
    plain = {k: "".join(map(chr, language_id.letter_codes(v))) for k, v in learned.items()}
    blocks = [language_id.letter_codes(t)[:100] for t in texts[3:40]] + [language_id.letter_codes("ж zzz ж")]
    got = known.phrases(blocks)
    for block, counts in zip(blocks, got):
        text = "".join(map(chr, block))
        assert counts.tolist() == [_phrases(text, plain[k]) for k in "abc"]


@pytest.mark.parametrize("dense", [0, 1, 5, 30])
def test_rare_signs_parse_like_a_search(corpus, dense):
    texts = list(corpus.values())
    learned = {"a": texts[0][:700], "b": "жёлтый цвет " * 9 + texts[1][:500], "c": ""}
    known = language_id.Parser(learned, dense)
    plain = {k: "".join(map(chr, language_id.letter_codes(v))) for k, v in learned.items()}
    blocks = [language_id.letter_codes(t)[:100] for t in [*texts[3:40], "ж zzz ж цвет цёт", "цвет ω ωω"]]
    for block, counts in zip(blocks, known.phrases(blocks)):
        assert counts.tolist() == [_phrases("".join(map(chr, block)), plain[k]) for k in "abc"]


def test_alphabets_of_thousands_of_signs_need_little_memory():
    draw = np.random.default_rng(2)
    words = {k: ["".join(map(chr, x)) for x in draw.integers(0x4E00 + 5_000 * k, 0x4E00 + 5_000 * k + 5_000, (4_000, 3))]
             for k in range(4)}
    texts = {f"l{k}": "".join(draw.choice(w, 10_000)) for k, w in words.items()}
    tracemalloc.start()
    known = language_id.Parser(texts)
    found = known.predict(["".join(draw.choice(words[k % 4], 500)) for k in range(200)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x for x, _ in found] == [f"l{k % 4}" for k in range(200)] and peak < 700 << 20


def test_language_accuracy(spark, sf_dir, documents):
    got = queries.op1_language_id(spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_language_odd_rows(odd, documents, nothing):
    got = {r.doc_id: r for r in language_id.predict(odd, language_id.learn(documents)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 13)] == ["und"] * 4 and got[7].lang_pred == "en"
    assert language_id.identify(odd).count() == odd.count()
    assert language_id.identify(nothing).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, {}).collect()} == {"und"}


# ---- secrets --------------------------------------------------------------------------------

def _base(text):
    """The contract's patterns, plainly."""
    rules = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
             ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))
    found = []
    for k, (kind, pattern) in enumerate(rules):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if {"assign": lambda: len(m[2]) >= 8, "access": lambda: len(m[0]) >= 16, "hex": lambda: len(m[0]) >= 32}[kind]():
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(found)]


def test_base_spans(corpus):
    odd = ["secret:token: abcdefgh12", "PASSWORD='x' passwd = abcdefgh", "API_KEY=\"12345678\" apikey:1234567", "AKIA" + "A" * 11,
           "AKIA" * 5, "f" * 31 + " " + "f" * 32 + "g", "toKen=K token==========", "paſſword=abcdefghij", "é token = abcdefgh"]
    for text in [*corpus.values(), *odd]:
        base, spans, _ = secret_scan.scan(text)
        names = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert names == _base(text)
        assert set(base) <= set(spans)


SECRET = "password=hunter2hunter2"


@pytest.mark.parametrize("wrap", [
    lambda s: quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode().rstrip("="),
    lambda s: base64.urlsafe_b64encode(("ÿþ?>~" * 9 + s).encode()).decode(),
    lambda s: "a-name_" + base64.b64encode(s.encode()).decode(), lambda s: "pa/th/" + base64.b64encode(s.encode()).decode(),
    lambda s: base64.b64encode(bz2.compress(zlib.compress(s.encode()))).decode(),
    lambda s: quote(base64.b64encode(s.encode()).decode(), safe="").replace("=", "%3D"),
    lambda s: base64.b64encode(base64.b64encode(base64.b64encode(s.encode()))).decode(),
    lambda s: base64.b64encode(quote("\\u0020" + s, safe="").encode()).decode(), lambda s: quote(quote(quote(s, safe=""), safe=""), safe="")])
def test_nested_layers_map_to_the_wrapping(wrap):
    inner = wrap(SECRET)
    text = f"é before {inner} after"
    base, spans, _ = secret_scan.scan(text)
    assert not base
    assert any(text[s:e] in inner for s, _, e in spans), spans
    assert "hunter2" not in secret_scan.redacted(text, spans) and all(9 <= s and e <= 9 + len(inner) for s, _, e in spans)


@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress])
@pytest.mark.parametrize("width, join", [(76, "\n"), (76, "\r\n    "), (64, "\n\t"), (20, "\n"), (12, "\n  "), (75, "\n")])
def test_wrapped_base64_is_read_to_its_last_character(pack, width, join):
    draw, ends = np.random.default_rng(4), set()
    for n in range(40, 40 + 3 * 57):
        filler = "".join(chr(97 + k) for k in draw.integers(0, 26, n))
        run = base64.b64encode(pack(f"{filler} {SECRET}".encode())).decode()
        for body in (run, run.rstrip("=")):
            ends.add((len(body) - 1) % width + 1)
            block = join.join(body[i:i + width] for i in range(0, len(body), width))
            for text in (f"é before {block} after", f"é before\n{block}\n\nafter", f"é before{join}{block}\nafter, too"):
                spans = secret_scan.scan(text)[1]
                low, high = text.index(block), text.index(block) + len(block.rstrip("= \t\r\n"))
                assert any(s <= low and high <= e for s, _, e in spans), (n, text)
    if pack is bytes:
        assert ends >= {k for k in range(2, width + 1) if width % 4 or k % 4 != 1}


def test_wrapped_base64_beside_another_run():
    def lines(data, width):
        body = base64.b64encode(data).decode().rstrip("=")
        return "\n".join(body[i:i + width] for i in range(0, len(body), width))
    for pack in (bytes, gzip.compress, bz2.compress):
        first, second = (lines(pack(("x y " * k + s).encode()), 32) for k, s in ((9, SECRET), (11, "token=abcdefgh5678")))
        text = f"one\ntwo\n{first}\n{second}\n\nthree"
        spans = secret_scan.scan(text)[1]
        for block in (first, second):
            low = text.index(block)
            assert any(s <= low and low + len(block) <= e for s, _, e in spans), pack


def test_escapes_map_to_their_characters():
    text = "x token%3Dabcdefgh%31 y"
    assert secret_scan.scan(text)[1] == [(2, 0, 21)]


def test_cycles_and_bombs_end(monkeypatch):
    monkeypatch.setattr(secret_scan, "MAX_UNPACKED_BYTES", 1000)
    bomb = base64.b64encode(zlib.compress(b"0" * 100_000)).decode()
    base, spans, bombs = secret_scan.scan(f"{bomb} token=abcdefgh")
    assert bombs == 1 and len(base) == 1
    assert secret_scan.cleaned(f"a {bomb} token=abcdefgh b") == "a [secret] [secret] b"
    assert secret_scan.scan("%25" * 50 + "&#38;#38;")[2] == 0
    for chain in ("%" + "25" * 200_000 + "41", "&" + "#38;" * 100_000 + "#65;", "\\" + "u005c" * 100_000 + "u0041"):
        assert (len(chain) + 3, 0, len(chain) + 17) in secret_scan.scan("x " + chain + " token=abcdefgh")[1]


PLAIN = "password=abcdefgh1234"


def _raw(data):
    pack = zlib.compressobj(wbits=-15)
    return pack.compress(data) + pack.flush()


@pytest.mark.parametrize("run", [
    "%FF" + "".join(f"%{b:02X}" for b in PLAIN.encode()), "%C3" + "".join(f"%{b:02x}" for b in PLAIN.encode()) + "%80",
    *(base64.b64encode(x).decode() for x in (
        b"\x01 " + PLAIN.encode() + b" \x02", f"caf\u00e9 {PLAIN} \u00fc".encode("latin-1"), PLAIN.encode("utf-16"),
        PLAIN.encode("utf-16-le"), PLAIN.encode("utf-16-be"), b"\xff" * 7 + PLAIN.encode() + b"\xfe",
        gzip.compress(b"nothing here") + gzip.compress(PLAIN.encode()), bz2.compress(b"none") + bz2.compress(PLAIN.encode()),
        gzip.compress(b"nothing here") + b"\n" + PLAIN.encode(), _raw(PLAIN.encode()), _raw(gzip.compress(PLAIN.encode())),
        b"\x00\x01head" + gzip.compress(PLAIN.encode()), lzma.compress(PLAIN.encode("utf-16")))),
    *(glue + base64.b64encode(x).decode() for glue in ("a", "ab", "abc", "abcd", "abcde")
      for x in (PLAIN.encode(), gzip.compress(PLAIN.encode()), bz2.compress(PLAIN.encode()), PLAIN.encode("utf-16"))),
    *(glue + base64.b64encode(zlib.compress(PLAIN.encode())).decode() for glue in ("a", "ab", "abc"))])
def test_layers_that_are_not_plain_text(run):
    text = f"before {run} after"
    base, spans, bombs = secret_scan.scan(text)
    assert not base and spans and not bombs
    assert all(7 <= s and e <= 7 + len(run) for s, _, e in spans)


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, _raw, lambda x: gzip.compress(bz2.compress(x))])
def test_large_layers_are_read_in_windows(monkeypatch, pack):
    monkeypatch.setattr(secret_scan, "WINDOW_BYTES", 4_000)
    monkeypatch.setattr(secret_scan, "CHUNK_BYTES", 100)
    for n in range(11_900, 12_100, 7):
        words = ("lorem ipsum " * 1_500)[:n]
        inner = base64.b64encode(PLAIN.encode()).decode()
        for secret in (PLAIN, inner):
            text = "é " + base64.b64encode(pack(f"{words} {secret} {words}".encode())).decode() + "\nend"
            _, spans, bombs = secret_scan.scan(text)
            assert spans and not bombs and all(s == 2 for s, _, _ in spans), n
    solid = base64.b64encode(pack(b"0123456789" * 1_000)).decode()
    assert secret_scan.scan(solid)[2] == 1 and secret_scan.cleaned("x " + solid) == "x [secret]"


def test_clean_prose_has_no_secrets(corpus):
    for text in corpus.values():
        if not _base(text):
            assert not secret_scan.scan(text)[1]


def test_secret_frames(odd, nothing):
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.find(odd)).collect()}
    assert (got[18].n_assign, got[18].n_access, got[18].n_hex) == (1, 1, 1)
    assert got[0].spans == got[1].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = secret_scan.redact(odd)
    assert clean.schema == odd.schema and clean.count() == odd.count()
    row = {r.doc_id: r for r in clean.collect()}
    assert row[18].text == "[secret]\" and token:xyz [secret] [secret]"
    assert row[18].n_chars == len(row[18].text) and row[0].text is None
    before = {r.doc_id: r.text for r in odd.collect()}
    assert all(r.text == before[i] for i, r in row.items() if not got[i].spans)
    assert secret_scan.find(nothing).count() == secret_scan.redact(nothing).count() == 0


# ---- quality model --------------------------------------------------------------------------

def test_quality_model_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_quality_model(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_word_vectors_equal_a_plain_sum(spark, corpus):
    texts = list(corpus.values())[:5]
    places, signs = quality_model.index_vectors()
    want = np.zeros((quality_model.ROWS, quality_model.DIMENSIONS))
    for text in texts:
        rows = quality_model.token_rows(text)
        for i, row in enumerate(rows):
            for j in range(max(0, i - 2), min(len(rows), i + 3)):
                if i != j:
                    want[row, places[rows[j]]] += signs[rows[j]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = np.zeros_like(want)
    for row in quality_model.context_sums(docs).collect():
        got[row[0]] = row[1:]
    assert (got == want).all()


def test_quality_model_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, None), (7, 1, 0), (8, None, 0), (None, 1, 0), (13, 0, 0), (13, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality_model.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    none = quality_model.score(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.score(nothing, labels).count() == 0


def test_temperature_calibrates():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(4000, 3))
    y = (draw.random(4000) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(float)
    p = quality_model.train(x, y, epochs=15).probabilities(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        own = (p >= low) & (p < low + 0.2)
        assert abs(p[own].mean() - y[own].mean()) < 0.08


# ---- quality rules --------------------------------------------------------------------------

def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    filled = [bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in lines]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(f and x in lines[:i] for i, (x, f) in enumerate(zip(lines, filled))), len(covered))


def test_quality_counts(odd, documents):
    for docs in (odd, documents):
        texts = sorted((r.text or "" for r in docs.collect()))
        got = quality_rules.judge(docs).collect()
        want = sorted(_counts(t) for t in texts)
        assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
        assert not any(r.kept and r.base_failed for r in got)


def test_distances_equal_a_plain_version(documents):
    rows = documents.collect()
    words, classes = {}, {}
    for r in rows:
        words.setdefault(r.lang, Counter()).update(quality_rules.plain_words(r.text.encode()))
        classes[r.lang] = classes.get(r.lang, 0) + quality_rules.class_counts(r.text)

    def distance(p, q):
        keys = set(p) | set(q)
        a, b = sum(p.values()), sum(q.values())
        out = 0
        for k in keys:
            x, y = p.get(k, 0) / a, q.get(k, 0) / b
            m = (x + y) / 2
            out += sum(v * np.log2(v / m) for v in (x, y) if v) / 2
        return out ** 0.5
    got = {r.doc_id: r for r in quality_rules.judge(documents).collect()}
    for r in rows:
        total = sum(words[r.lang].values())
        if got[r.doc_id].class_distance is not None:
            want = distance(dict(enumerate(quality_rules.class_counts(r.text))), dict(enumerate(classes[r.lang])))
            assert abs(got[r.doc_id].class_distance - want) < 1e-6
        if got[r.doc_id].word_distance is not None:
            common = {w for w, n in words[r.lang].items() if n >= total / 500}
            fold = lambda c: Counter({w: c[w] for w in common}) + Counter({"": sum(n for w, n in c.items() if w not in common)})
            want = distance(fold(Counter(quality_rules.plain_words(r.text.encode()))), fold(words[r.lang]))
            assert abs(got[r.doc_id].word_distance - want) < 1e-6


def test_rules_reject_junk_and_keep_prose(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    long_good = [r for r in rows if r.quality == 1 and r.n_words >= 50]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in long_good) >= 0.99 * len(long_good)
    assert sum(r.kept for r in bad) <= 0.4 * len(bad)


def test_rules_frames(odd, nothing):
    kept = quality_rules.keep_good(odd)
    assert kept.schema == odd.schema
    want = sorted(str(r.doc_id) for r in quality_rules.judge(odd).filter("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want and "7" in want and "13" not in want
    assert quality_rules.judge(nothing).count() == quality_rules.keep_good(nothing).count() == 0
