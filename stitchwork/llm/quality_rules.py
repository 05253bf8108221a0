"""Document quality by counts and by divergence from a language's own distributions.

A document's histogram of character classes, and of its language's common
words, is compared with the histogram over all documents of that language by
the Jensen-Shannon distance. Documents too short for a histogram are judged by
the counts alone.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.llm.common import SPACE, ship, worker_cache

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A word is common in a language if it makes at least this share of its words: no more than 500 words can.
COMMON_SHARE = 1 / 500
#: Jensen-Shannon distances (0 to 1) from which a document is rejected.
MAX_CLASS_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.45
#: Guards: fewer words than these leave a histogram too thin to compare.
MIN_CLASS_WORDS = 50
MIN_COMMON_WORDS = 100
#: Words that a language's reference must rest on.
MIN_REFERENCE_WORDS = 2000
#: Distinct words that a task gathers before it hands them on; sums are the same wherever it cuts.
FLUSH_WORDS = 500_000

CLASSES = ("lower", "upper", "digit", "space", "symbol", "period", "other punctuation", "mark", "other")
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def class_table() -> np.ndarray:
    """Class number of every code point."""
    held = worker_cache()
    if "character classes" not in held:
        by_category = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Zs": 3, "Zl": 3, "Zp": 3, "Mn": 7, "Mc": 7}
        table = np.full(0x110000, 8, np.uint8)
        for code in range(0x30000):
            category = unicodedata.category(chr(code))
            table[code] = by_category.get(category, 0 if category in ("Lo", "Lm") else 6 if category[0] in "PS" else 8)
        for char in SPACE:
            table[ord(char)] = 3
        for char in SYMBOLS:
            table[ord(char)] = 4
        for char in ".,;:":
            table[ord(char)] = 5
        held["character classes"] = table
    return held["character classes"]


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(class_table()[codes], minlength=len(CLASSES))


def plain_words(raw: bytes) -> list[bytes]:
    """Runs of letters (and of any byte beyond ASCII), A-Z lower-cased."""
    return raw.lower().translate(_LETTERS).split()


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen, repeated = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(SPACE):
                repeated += line in seen
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    covered = 0
    if len(set(windows)) < len(windows):
        counts, reach = Counter(windows), 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered += i + 3 - max(i, reach)
                reach = i + 3
    return (len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), repeated, covered)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2: 0 for equal shapes, 1 for disjoint ones."""
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def _count(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, kind (0 class, 1 word), item, n: sums per task, then per language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, 0, str(i).encode(), int(n)) for k, v in classes.items() for i, n in enumerate(v) if n]
            rows += [(k, 1, w, n) for k, v in words.items() for w, n in v.items()]
            words.clear()
            classes.clear()
            columns = list(zip(*rows)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.int64()))],
                names=["lang", "kind", "item", "n"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if value:
                    key = key or ""
                    words.setdefault(key, Counter()).update(plain_words(value.encode("utf-8", "surrogatepass")))
                    classes[key] = classes.get(key, 0) + class_counts(value)
            if sum(map(len, words.values())) > FLUSH_WORDS:
                yield out()
        yield out()

    counted = docs.select(F.col(lang).cast("string"), text).mapInArrow(run, "lang string, kind int, item binary, n long")
    return counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple]:
    """language -> (class counts, {common word: place}, counts of the common words and of all others).

    Counted over every document. What reaches the driver is nine classes and
    at most 1 / COMMON_SHARE words a language. Documents without a language
    are one more language.
    """
    counted = _count(docs, text, lang)
    totals = counted.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    kept = (counted.join(totals, ["lang", "kind"])
            .filter((F.col("kind") == 0) | (F.col("n") >= F.col("total") * COMMON_SHARE)))
    out: dict[str, list] = {}
    for row in kept.collect():
        classes, words = out.setdefault(row.lang, [np.zeros(len(CLASSES)), {}])
        if row.kind == 0:
            classes[int(row.item)] = row.n
        else:
            words[bytes(row["item"])] = (row.n, row.total)
    result = {}
    for key, (classes, words) in out.items():
        order = sorted(words, key=lambda w: (-words[w][0], w))
        total = words[order[0]][1] if order else 0
        counts = np.array([*(words[w][0] for w in order), 0], float)
        counts[-1] = total - counts.sum()
        result[key] = (classes, {w: i for i, w in enumerate(order)}, counts, total)
    return result


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "class_distance double, word_distance double, kept boolean")


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
          max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
          carry: bool = False) -> DataFrame:
    """One row per row of docs: id, the counts, base_failed, both distances (null where a guard holds), kept.

    Null text counts as empty: no words, base_failed, not kept. A null
    language is a language of its own. A document is kept unless it fails the
    counts or a distance reaches its limit. Repeated rows and null ids give a
    row each; an empty table gives no rows. With ``carry`` all columns of docs
    come along in the struct ``doc``, and id is left out.
    """
    known = references(docs, text, lang)
    key_of = F.col(lang).cast("string").alias("_lang")
    slim = (docs.select(F.struct(*docs.columns).alias("doc"), key_of) if carry
            else docs.select(id, key_of, F.col(text).alias("_text")))
    kind = slim.schema[0].dataType.simpleString()

    def verdict(value: str, key: str) -> tuple:
        raw = value.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        chars, symbols, lines, repeats = base_counts(value, words)
        failed = n < MIN_WORDS or 100 * repeats > 50 * n
        classes, places, counts, total = known.get(key, (None, None, None, 0))
        by_class = by_word = None
        if total >= MIN_REFERENCE_WORDS:
            if n >= MIN_CLASS_WORDS:
                by_class = distance(class_counts(value).astype(float), classes)
            plain = plain_words(raw)
            if len(plain) >= MIN_COMMON_WORDS and places:
                own, rest = np.zeros(len(counts)), len(plain)
                for word, k in Counter(plain).items():
                    if word in places:
                        own[places[word]] = k
                        rest -= k
                own[-1] = rest
                by_word = distance(own, counts)
        kept = not (failed or by_class is not None and by_class >= max_class or by_word is not None and by_word >= max_word)
        return n, chars, symbols, lines, repeats, failed, by_class, by_word, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text) if carry else batch.column(2)
            rows = [verdict(x or "", key or "") for x, key in zip(texts.to_pylist(), batch.column(1).to_pylist())]
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            arrays = [pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[batch.schema.names[0], *(
                x.split()[0] for x in SCHEMA.split(", "))])

    return slim.mapInArrow(run, f"`{slim.columns[0]}` {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the documents that ``judge`` rejects, in one pass after the references; columns as in docs."""
    return judge(docs, docs.columns[0], text, lang, carry=True).filter("kept").select("doc.*")


ship(__name__)
