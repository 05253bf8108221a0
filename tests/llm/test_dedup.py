"""Exact, near and passage duplicates against plain versions."""

import hashlib
import itertools
import random
from collections import defaultdict

import pytest
import xxhash
from llm_cases import prose
from pyspark.sql import functions as F

from stitchwork.llm import exact_dedup, graph, simhash, suffix_dedup


# ---- exact ----------------------------------------------------------------------------------

def _exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        own = groups[text or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((doc_id, keep, len(own), doc_id == keep))
    return sorted(out, key=str)


def test_exact_decisions(odd, documents):
    for docs in (odd, documents):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        sha = F.coalesce(F.col("_full"), F.sha2(F.col("_text"), 256))
        got = exact_dedup.decide(docs, extra={"text_sha256": sha}).collect()
        assert sorted((tuple(r)[:4] for r in got), key=str) == _exact(rows)
        assert sorted(r.text_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)


def test_exact_levels_agree_for_any_prefix(odd):
    sets = [sorted(map(str, exact_dedup.decide(odd, prefix_chars=n).collect())) for n in (1, 5, 10_000)]
    assert sets[0] == sets[1] == sets[2]


def test_exact_levels_agree_where_keys_are_too_many_to_broadcast(odd):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few, many = (exact_dedup.decide(odd, broadcast_keys=n) for n in (1000, 0))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    texts = [sorted(str(r.text) for r in exact_dedup.keep_one(odd, broadcast_keys=n).collect()) for n in (1000, 0)]
    assert texts[0] == texts[1]
    assert plan(few).count("BroadcastHashJoin") >= 2 and "ShuffledHashJoin" in plan(many)


def test_exact_reads_prefixes_of_shared_lengths_and_hashes_of_shared_prefixes(spark):
    head = "x" * 300
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "cd"), (4, "abc"), (5, head + "1"), (6, head + "2")], "doc_id long, text string")
    got = {r["_doc"].doc_id: r["_full"] for r in exact_dedup.full_hashes(docs).collect()}
    assert {k for k, v in got.items() if v} == {2, 3, 5, 6} and got[2] == got[3] and got[5] != got[6]


def test_exact_keeps_one_row(odd, nothing):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    best = {r.text or "": r.doc_id for r in kept.collect()}
    assert best["Hello World"] == 6 and best[prose(1, 300)] == 8
    assert exact_dedup.keep_one(nothing).count() == exact_dedup.decide(nothing).count() == 0


# ---- SimHash --------------------------------------------------------------------------------

def _fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    parts = [words[i:i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, bits=4):
    """{doc: smallest reachable} by comparing every pair."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot_key", [2000, 1])
def test_simhash_components(documents, corpus, hot_key):
    prints = {i: _fingerprint(t) for i, t in corpus.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.link(documents, hot_key=hot_key).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: c for i, (_, c) in got.items()} == _components(prints)


def _clustered(seed, n):
    """Fingerprints in dense balls and chains, and lone ones."""
    draw = random.Random(seed)
    out = set()
    while len(out) < n:
        centre = draw.getrandbits(64)
        out.add(centre)
        for _ in range(draw.choice((0, 0, 3, 25))):
            value = centre
            for bit in draw.sample(range(64), draw.randint(1, 5)):
                value ^= 1 << bit
            out.add(value)
            centre = draw.choice((centre, value))
    return sorted(out)


@pytest.mark.parametrize("hot_key, links", [(10**6, 2), (3, 2), (0, 2), (10**6, 3), (2, 3)])
def test_pigeonring_loses_no_connection(spark, hot_key, links):
    prints = _clustered(5, 400)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), hot_key, links)
    roots = {r.node: r.root for r in graph.components(links).collect()}
    mask = (1 << 64) - 1
    want = _components({p: p & mask for p in signed})
    assert {p: roots.get(p, p) for p in signed} == want
    assert all(((r.a ^ r.b) & mask).bit_count() <= 4 for r in links.collect())


@pytest.mark.parametrize("links", [2, 3])
def test_simhash_pairs_once_and_complete(spark, links):
    prints = _clustered(6, 300)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = [(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), links=links).collect()]
    mask = (1 << 64) - 1
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & mask).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_odd_rows(odd, nothing):
    got = simhash.link(odd).collect()
    assert len(got) == odd.count()
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id in (7, 8, 9)} == {7}
    assert simhash.link(nothing).count() == 0
    kept = simhash.keep_representatives(odd)
    assert kept.schema == odd.schema
    ids = [r.doc_id for r in kept.collect()]
    assert not {1, 2, 5, 6, 8, 9} & set(ids) and {0, 4, 7} <= set(ids)
    assert simhash.keep_representatives(nothing).count() == 0


def test_representatives_are_rows(spark):
    """An id with several texts, repeated rows, rows without an id, and columns named like those inside."""
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (None, a), (5, None), (5, ""), (6, " ")]
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], "doc_id long, text string, _loser string, _row string, same string, root string")
    kept = simhash.keep_representatives(df.repartition(4))
    assert kept.schema == df.schema
    got = sorted(((r.doc_id, (r.text or "").strip()) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, c), (5, "")], key=str)


def test_components_of_chains_and_stars(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(160, 100), (7, 7)]
    draw.shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 600)}}


# ---- repeated passages ----------------------------------------------------------------------

def _repeats(rows, n):
    places = defaultdict(set)
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - n + 1):
            places[tuple(words[i:i + n])].add((doc_id is not None, doc_id or 0, i))
    covered, later = set(), set()
    for found in places.values():
        if len(found) > 1:
            for known, doc_id, i in found:
                covered.update((known, doc_id, w) for w in range(i, i + n))
                if (known, doc_id, i) != min(found):
                    later.update((known, doc_id, w) for w in range(i, i + n))
    return covered, later


def _words(spans, removable):
    return {(r.doc_id is not None, r.doc_id or 0, w) for r in spans if r.removable == removable
            for w in range(r.start_word, r.end_word)}


@pytest.mark.parametrize("n, gram", [(50, 20), (50, 12), (20, 7)])
def test_repeated_passages(documents, odd, n, gram):
    for docs in (documents, odd):
        covered, later = _repeats([(r.doc_id, r.text) for r in docs.collect()], n)
        spans = suffix_dedup.repeats(docs, min_words=n, gram=gram).collect()
        assert _words(spans, False) == covered
        assert _words(spans, True) <= later
        # Every first occurrence but none else could be lost: a later one is removable unless its windows are inner ones.
        assert {(k, d) for k, d, _ in later} == {(k, d) for k, d, _ in _words(spans, True)}


def test_partners_of_different_extent(spark):
    a, b, c = prose(11, 40), prose(12, 60), prose(13, 40)
    texts = [f"{a} {b} {c}", f"{prose(14, 30)} {b} {c} {prose(15, 9)}", f"{prose(16, 33)} {a} {b} {prose(17, 50)}",
             f"{prose(18, 70)} {' '.join(b.split()[:52])} {prose(19, 12)}", prose(20, 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    covered, _ = _repeats(list(enumerate(texts)), 50)
    assert _words(suffix_dedup.repeats(docs).collect(), False) == covered and covered


def test_removable_words_are_whole(spark, documents):
    draw = random.Random(8)

    def words(n):
        return [f"w{draw.getrandbits(40)}" for _ in range(n)]
    rows = []
    for length in range(50, 82):  # a passage in two groups of copies: the first copy of the second group has it later
        passage = words(length)
        for text in (words(draw.randint(0, 90)) + passage + words(draw.randint(0, 90)) for _ in range(2)):
            rows += [(len(rows) + k, " ".join(text)) for k in range(2)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string").repartition(5), documents):
        covered, later = _repeats([(r.doc_id, r.text) for r in docs.collect()], 50)
        spans = suffix_dedup.repeats(docs).collect()
        assert _words(spans, False) == covered and _words(spans, True) == later and later


def test_no_repeats_in_an_empty_table(nothing):
    assert suffix_dedup.repeats(nothing).count() == 0
