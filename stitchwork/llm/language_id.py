"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled text recognises
every substring of it. A text is parsed greedily into the longest phrases that
a language's text contains; the language that needs the fewest phrases,
normalised by the logarithm of its text's length, is the one. Automata are
transition tables, dense for the most common signs and sorted keys for the
others, so that NumPy steps through many texts and all languages at once and
an alphabet of thousands of signs costs no more memory than a short one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stitchwork.llm.common import by_rank, held_out, portions, ship, worker_cache

#: Labelled documents per language that the automata may learn from, and characters taken of them in all.
SAMPLE_DOCS = 200
SAMPLE_CHARS = 30_000
#: Phrases end at every so many letters and blanks, so that long texts parse side by side.
BLOCK_CHARS = 2_048
#: Signs that have a column in the dense table: about 31 MB for each language. The others are looked up by sorted keys.
DENSE_SIGNS = 127
#: Characters of the texts that are parsed at once.
PORTION_CHARS = 2_000_000
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """Whether each code point is a letter (0 no, 1 yes)."""
    held = worker_cache()
    if "letters" not in held:
        table = np.zeros(0x110000, bool)
        for code in range(0x33480):
            table[code] = unicodedata.category(chr(code))[0] == "L"
        held["letters"] = table
    return held["letters"]


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of anything but letters as one blank; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return codes[:0]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.where(is_letter, codes, 32)[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state and symbol of the automaton of all substrings. State 0 is empty."""
    moves, link, longest, last = [{}], [-1], [0], 0
    for symbol in symbols:
        state = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        back = last
        while back >= 0 and symbol not in moves[back]:
            moves[back][symbol] = state
            back = link[back]
        if back >= 0:
            after = moves[back][symbol]
            if longest[after] == longest[back] + 1:
                link[state] = after
            else:
                twin = len(moves)
                moves.append(dict(moves[after]))
                longest.append(longest[back] + 1)
                link.append(link[after])
                while back >= 0 and moves[back].get(symbol) == after:
                    moves[back][symbol] = twin
                    back = link[back]
                link[after] = link[state] = twin
        last = state
    return moves


def _entries(moves: list[dict[int, int]]) -> tuple[int, np.ndarray]:
    """Number of states, and the transitions as rows of state, symbol, next state."""
    flat = np.fromiter((x for state, out in enumerate(moves) for symbol, after in out.items() for x in (state, symbol, after)), np.int32)
    return len(moves), flat.reshape(-1, 3)


class Parser:
    """All languages' automata in one table, with the alphabet they share, common signs first.

    Symbol 0 stands for unseen characters.
    """

    def __init__(self, learned: dict[str, str], dense_signs: int = DENSE_SIGNS):
        self.langs = sorted(learned)
        texts = [letter_codes(learned[x]) for x in self.langs]
        alphabet, times = np.unique(np.concatenate(texts) if texts else np.zeros(0, np.uint32), return_counts=True)
        alphabet = alphabet[np.argsort(-times, kind="stable")]
        self.symbol = np.zeros(0x110000, np.uint8 if len(alphabet) < 256 else np.int32)
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        automata = [_entries(suffix_automaton(self.symbol[codes].tolist())) for codes in texts]
        states, width = sum(n for n, _ in automata), min(len(alphabet), dense_signs) + 1
        self.width, self.rare = width, max(1, len(alphabet) + 1 - width)
        #: At row + symbol: the next state's row, times 4, plus the phrases that end.
        self.step = np.empty((states, width), np.int32 if states * width * 4 < 2**31 else np.int64)
        kind = self.step.dtype
        #: The same for rare signs: by state and sign where the automaton has them, else by language.
        keys, values, self.otherwise = [], [], np.empty((len(texts), self.rare), kind)
        roots, total = [], 0
        for k, (n, entries) in enumerate(automata):
            common = entries[entries[:, 1] < width]
            table = np.full((n, width), -1, kind)
            table[common[:, 0], common[:, 1]] = common[:, 2]
            # Where a phrase ends, the symbol starts the next one; a symbol that no text has is a phrase by itself.
            ended, unseen = table < 0, table[0] < 0
            fresh = np.where(unseen, 0, table[0])
            np.copyto(table, fresh, where=ended)
            table += total
            table *= width * 4
            table += ended & unseen
            table[1:] += ended[1:]
            self.step[total:total + n] = table
            seldom = entries[entries[:, 1] >= width].astype(np.int64)
            sign = seldom[:, 1] - width
            keys.append((seldom[:, 0] + total) * self.rare + sign)
            values.append(((seldom[:, 2] + total) * width * 4).astype(kind))
            self.otherwise[k] = total * width * 4 + 2
            first = seldom[:, 0] == 0
            self.otherwise[k, sign[first]] = values[-1][first] + 1
            roots.append(total)
            total += n
        self.step = self.step.ravel()
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.values = np.concatenate(values)[order] if keys else np.zeros(0, kind)
        self.root_rows = (np.array(roots, np.int64) * width).astype(kind)[:, None]
        self.norm = np.array([np.log2(max(2, len(x))) for x in texts])

    def _rare_steps(self, row: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Entries of rare signs (lanes) at the rows of all languages (languages x lanes)."""
        key = row.astype(np.int64) // self.width * self.rare + sign
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        # Only an unseen sign has two phrases, and at a root there is none to end before it.
        other = self.otherwise[:, sign] - ((row == self.root_rows) & (self.otherwise[:, sign] & 3 == 2))
        return np.where(self.keys[at] == key, self.values[at], other)

    def phrases(self, blocks: list[np.ndarray]) -> np.ndarray:
        """Phrases of each block in each language (blocks x languages)."""
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        lengths = np.array([len(blocks[i]) for i in order])
        steps, n, k = int(lengths.max(initial=0)), len(blocks), len(self.langs)
        grid = np.zeros((steps, n), self.symbol.dtype)
        for lane, i in enumerate(order):
            grid[:len(blocks[i]), lane] = self.symbol[blocks[i]]
        row = np.repeat(self.root_rows, n, axis=1)
        counts = np.zeros((k, n), self.step.dtype)
        alive = n - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
        has_rare = (grid >= self.width).any(axis=1)
        for t in range(steps):
            m = alive[t]
            if has_rare[t]:
                symbol = grid[t, :m].astype(np.int64)
                lanes = np.flatnonzero(symbol >= self.width)
                found = self.step.take(row[:, :m] + np.where(symbol < self.width, symbol, 0))
                found[:, lanes] = self._rare_steps(row[:, lanes], symbol[lanes] - self.width)
            else:
                found = self.step.take(row[:, :m] + grid[t, :m])
            counts[:, :m] += found & 3
            row[:, :m] = found >> 2
        counts += row != self.root_rows
        out = np.zeros((n, k), np.int64)
        out[order] = counts.T
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text. Score: each further phrase that a language needs halves its odds."""
        blocks, owner = [], []
        for i, text in enumerate(texts):
            codes = letter_codes(text) if text else ()
            for at in range(0, len(codes), BLOCK_CHARS):
                blocks.append(codes[at:at + BLOCK_CHARS])
                owner.append(i)
        cost = np.zeros((len(texts), len(self.langs)))
        if blocks and self.langs:
            np.add.at(cost, owner, self.phrases(blocks))
            cost *= self.norm / self.norm.mean()
        known = set(owner)
        out = []
        for i in range(len(texts)):
            if i not in known or not self.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(cost[i].argmin())
            out.append((self.langs[best], float(1 / np.exp2(np.maximum(cost[i, best] - cost[i], -1000)).sum())))
        return out


def parser(learned: dict[str, str]) -> Parser:
    """This worker's parser of these texts."""
    held = worker_cache()
    key = ("languages", tuple(sorted(learned.items())))
    if key not in held:
        held[key] = Parser(learned)
    return held[key]


def learn(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """language -> text for its automaton: of the sample_docs documents that rank first, as many characters as fit.

    Each document gives an equal share, so no single one fills the text; the
    share is read from a place of the document that its id draws. What reaches
    the driver is bounded by the two parameters for each language.
    """
    rank = Window.partitionBy("lang").orderBy(by_rank(F.col("id"), 1), "id")
    chosen = (labelled.filter(F.col(lang).isNotNull() & F.length(text).isNotNull())
              .select(F.col(lang).cast("string").alias("lang"), F.col(id).alias("id"))
              .withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= sample_docs))
    ids = [(r.lang, r.id) for r in chosen.select("lang", "id").collect() if r.id is not None]
    if not ids:
        return {}
    share = max(1, sample_chars // max(1, min(sample_docs, len(ids) // len({x for x, _ in ids}))))
    spare = F.greatest(F.length(text) - 4 * share, F.lit(0)).cast("long")
    begin = (F.pmod(F.xxhash64(F.col(id), F.lit("place")), spare + 1) + 1).cast("int")
    rows = (labelled.filter(F.col(id).isin([x for _, x in ids]) & F.col(lang).isNotNull())
            .select(F.col(lang).cast("string").alias("lang"), F.col(id).alias("id"),
                    F.substring(F.col(text), begin, F.lit(4 * share)).alias("text")).distinct().collect())
    wanted, learned = set(ids), {}
    for row in sorted(rows, key=lambda r: (r.lang, r.id, r.text)):
        if (row.lang, row.id) in wanted and len(letter_codes(row.text)):
            part = row.text[:2 * share]
            if len(learned.get(row.lang, "")) < sample_chars:
                learned[row.lang] = (learned.get(row.lang, "") + "\n" + part)[:sample_chars]
    return learned


def predict(docs: DataFrame, learned: dict[str, str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score (0 to 1).

    und, score 0: text is null or has no letter, or nothing was learned. Ties
    go to the language first by name. Repeated rows and null ids give a row
    each; an empty table gives no rows. Whole texts are parsed.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parser(learned)
        for batch in batches:
            found = []
            for part in portions(batch.column(1).to_pylist(), PORTION_CHARS):
                found += known.predict(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=[id, "lang_pred", "score"])

    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict all: id, held_out, lang_pred, score."""
    learned = learn(docs.filter(~held_out(id)), id, text, lang)
    found = predict(docs, learned, id, text)
    return found.select(id, held_out(id).alias("held_out"), "lang_pred", "score")


ship(__name__)
