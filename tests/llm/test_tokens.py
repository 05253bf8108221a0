"""Token ids, packing and piece encoding against the libraries themselves."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stitchwork.llm import bpe, hierarchical_packing, piece_encoding, token_matrix


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def _ids(library, text, end):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def test_bpe_equals_the_library(library, corpus):
    encode = bpe.encoder()
    odd = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n", "x  y", "it's 12 o'clock", "<|endoftext|> b", "é" * 50,
           "東京 😀 ½", "a\tb  c\r\n d", "  wide"]
    for text in [*corpus.values(), *odd]:
        assert np.frombuffer(encode(text), "<u4").tolist() == _ids(library, text, 1)[:-1], text[:80]


@pytest.mark.parametrize("run", [" " * 1_200_000, "\t" * 1_000_003, " \n\t\x0b\u3000\x85" * 200_000])
@pytest.mark.parametrize("text", ["{}", "a{}b", "a{}", "{}'s <x> {}b{}"])
def test_long_blank_runs(library, run, text):
    text = text.replace("{}", run)
    assert np.frombuffer(bpe.encoder()(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ten_million_blanks_in_both_packers(spark):
    texts = [" " * 10_000_000 + "end", "a" + "\t" * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sum(len(bpe.encoder()(t)) // 4 + 1 for t in texts)
    assert sum(r.length for r in hierarchical_packing.pack(docs).select("length").collect()) == want


# ---- hierarchical packing -------------------------------------------------------------------

@pytest.mark.parametrize("name", ["documents", "odd"])
def test_packing(request, library, name):
    docs = request.getfixturevalue(name)
    pieces = hierarchical_packing.pack(docs).collect()
    want = sorted(tuple(_ids(library, r.text, 1)) for r in docs.collect())
    by_sequence, by_step, got = defaultdict(list), defaultdict(dict), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0
        by_sequence[p.sequence_id].append(p)
        by_step[p.step_group][p.sequence_id] = p.tier
        got[p.doc_id].append((p.start, tuple(ids), p.doc_tokens))
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == sequence[0].tier <= 2048 and at & (at - 1) == 0  # full, so never padded
    for step in by_step.values():
        assert len(set(step.values())) == 1 and sum(step.values()) <= hierarchical_packing.STEP_IDS
    assert sum(p.length for p in pieces) == sum(map(len, want))
    repeated = {r.doc_id for r in docs.groupBy("doc_id").count().filter("count > 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc_id, own in got.items():
        if doc_id not in repeated:
            ids = sum((list(ids) for _, ids, _ in sorted(own)), [])
            assert ids == _ids(library, texts[doc_id], 1) and {n for *_, n in own} == {len(ids)}


def test_packing_digest_and_empty_table(documents, nothing):
    pieces = {(r.doc_id, r.start): zlib.crc32(r.ids) for r in hierarchical_packing.pack(documents).collect()}
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in hierarchical_packing.digest(hierarchical_packing.pack(documents)).collect()}
    assert pieces == digest
    assert hierarchical_packing.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        hierarchical_packing.pack(nothing, tiers=(300, 2048))


def test_most_sequences_are_long(documents):
    sizes = hierarchical_packing.pack(documents).groupBy("tier").agg(F.sum("length").alias("n"))
    counts = {r.tier: r.n for r in sizes.collect()}
    assert counts[2048] > 0.5 * sum(counts.values())


# ---- matrices -------------------------------------------------------------------------------

def test_segment_tree_finds_the_tightest_row():
    tree = token_matrix.Capacities(100)
    for capacity in (0, 7, 7, 30, 100):
        tree.change(capacity, 1)
    assert [tree.least(w) for w in (0, 1, 7, 8, 30, 31, 100)] == [0, 7, 7, 30, 30, 100, 100]
    tree.change(100, -1)
    assert tree.least(31) is None and tree.least(8) == 30


def test_best_fit_decreasing_equals_a_plain_search():
    draw = np.random.default_rng(1)
    lengths = draw.integers(1, 101, 500).tolist()
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(100 - n)
    rows = token_matrix.best_fit_decreasing(lengths, 100)
    assert sorted(100 - sum(lengths[i] for i in row) for row in rows) == sorted(rooms)
    assert sorted(i for row in rows for i in row) == list(range(500))


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_matrices_lose_nothing(request, library, name):
    docs = request.getfixturevalue(name)
    packed = token_matrix.matrices(docs).withColumn("positions", token_matrix.position_ids("cu_seqlens"))
    got = defaultdict(list)
    for row in packed.collect():
        ids = np.frombuffer(row.input_ids, "<u2")
        assert len(ids) == token_matrix.ROW_IDS and row.cu_seqlens[-1] == row.n_ids
        assert all(ids[row.n_ids:] == token_matrix.END_ID)
        assert [i for i, p in enumerate(row.positions) if p == 0] == row.position_resets
        for doc, start, a, b in zip(row.doc_ids, row.doc_starts, row.cu_seqlens, row.cu_seqlens[1:]):
            got[doc].append((start, ids[a:b].tolist()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    repeated = {r.doc_id for r in docs.groupBy("doc_id").count().filter("count > 1").collect()}
    assert set(got) == set(texts)
    for doc_id, parts in got.items():
        if doc_id not in repeated:
            assert sum((ids for _, ids in sorted(parts)), []) == _ids(library, texts[doc_id], token_matrix.END_ID)


def test_matrices_written_and_empty(documents, nothing, tmp_path, spark):
    packed = token_matrix.matrices(documents)
    token_matrix.write_matrices(packed, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == packed.count()
    assert token_matrix.matrices(nothing).count() == 0


# ---- pieces ---------------------------------------------------------------------------------

ODD = ["", " ", "  ", " a", "a  b   c", "\n\t x", "½ ﬁ x", "12345 3.14", "ça été 東京 😀", "    def f(x):\n        return x_1", "aaaaaaaa bbb",
       "².", "a². b", "x__y ->_ z", "end  "]


def test_pieces_equal_the_library(corpus):
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.MODEL)
    known = piece_encoding.pieces()
    texts = [*corpus.values(), *ODD]
    for text, raw in zip(texts, known.encode_batch(texts)):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == lib.encode(text), text[:80]
        assert known.decode(ids) == text


def test_unigram_is_the_best_segmentation():
    """Small model: shared-prefix Viterbi against every segmentation."""
    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.1, "ba": -3.9, "aba": -6.0, "▁a": -2.5, "▁ab": -5.3, "bb": -9.0}
    known = piece_encoding.Pieces(list(scores), list(scores.values()), {}, 0, bpe=False)

    def best(word):
        if not word:
            return 0.0
        return max((scores[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in scores), default=-1e9)
    words = sorted({"▁" + "".join("ab"[i >> k & 1] for k in range(n)) for n in range(1, 8) for i in range(2**n)})
    for word, parts in known._forward(words):
        assert "".join(parts) == word and abs(sum(scores[p] for p in parts) - best(word)) < 1e-9


def test_pieces_of_long_blank_runs():
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.MODEL)
    known = piece_encoding.Pieces.load(piece_encoding.MODEL)
    texts = ["a" + " " * n + "b" for n in (1, 2, 3, 15, 16, 17, 33, 1_000, 20_000)] + [" " * 200_000, " x" * 3 + " " * 77 + "!  9"]
    assert [np.frombuffer(x, "<i4").tolist() for x in known.encode_batch(texts)] == lib.encode(texts, num_threads=1)


def test_word_memory_of_two_generations(monkeypatch, corpus):
    monkeypatch.setattr(piece_encoding, "KEPT_WORDS", 50)
    monkeypatch.setattr(piece_encoding, "KEPT_STATES", 100)
    monkeypatch.setattr(piece_encoding, "KEPT_PAIRS", 3)
    texts = [t for t in corpus.values() if t][:40]
    small, usual = piece_encoding.Pieces.load(piece_encoding.MODEL), piece_encoding.pieces()
    assert [small.encode_batch(texts[i:i + 4]) for i in range(0, 40, 4)] == [usual.encode_batch(texts[i:i + 4]) for i in range(0, 40, 4)]


def test_piece_frames(odd, nothing):
    encoded = piece_encoding.encode(odd)
    texts = sorted((r.text or "" for r in odd.collect()))
    assert sorted(r.text for r in piece_encoding.decode(encoded).collect()) == texts
    assert piece_encoding.decode(piece_encoding.encode(nothing)).count() == 0
