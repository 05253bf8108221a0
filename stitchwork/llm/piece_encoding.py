"""SentencePiece encoding and decoding with a forward pass shared by common prefixes.

A text is cut into marked words (a mark for each blank, then what follows up
to the next). The distinct words of a batch are sorted, which lays out their
trie depth-first; the forward pass keeps one entry per prefix and resumes at
the prefix a word shares with the one before it.

Two kinds of model are read. For unigram models the entry of a prefix is the
best sum of scores (Viterbi). For BPE models, whose scores are merge ranks and
must not be summed, the entry is the last piece of the prefix's encoding: a
piece may follow another exactly if merging the two alone keeps them apart, and
for every prefix just one piece does. Both give the library's own ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from stitchwork.llm.common import portions, ship, texts_of, worker_cache

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Words of one generation, states, and neighbours of a piece that a Python worker remembers. They change speed only.
KEPT_WORDS = 100_000
KEPT_STATES = 300_000
KEPT_PAIRS = 10_000
#: Characters of the texts that are cut into words at once.
PORTION_CHARS = 1_250_000

_WORDS = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
_RUNS = re.compile(rf"{MARK}*[^\W\d_{MARK}]+|{MARK}*(?:[^\w\n{MARK}]|_)+|{MARK}+|[\d\n]+")


class _Follows(dict):
    """left piece -> whether this piece may follow it: BPE of both together leaves exactly these two.

    Undo the merges of both from the last to the first: wherever the two
    neighbours at the border could have merged before either was extended,
    they would have.
    """

    __slots__ = ("piece", "rank", "split")

    def __init__(self, piece: str, rank: dict[str, float], split):
        super().__init__()
        self.piece, self.rank, self.split = piece, rank, split

    def __missing__(self, before: str) -> bool:
        left, right = before, self.piece
        rank, limit, apart = self.rank.get, np.inf, True
        while True:
            if rank(left + right, np.inf) < limit:
                apart = False
                break
            a, b = rank(left, -1), rank(right, -1)
            if a < 0 and b < 0:
                break
            if b >= a:
                limit, right = b + 0.5, self.split(right)[0]  # of equal merges the left one goes first
            else:
                limit, left = a, self.split(left)[1]
        if len(self) >= KEPT_PAIRS:
            self.clear()
        self[before] = apart
        return apart


class _Memory:
    """What was learned lately: two generations of a dictionary, of which the older one goes when the younger is full."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, self.young

    def unknown(self, keys: set[str]) -> set[str]:
        """Those of keys that must be learned; what only the older generation knows moves to the younger one."""
        missing = keys - self.young.keys()
        if self.old and missing:
            again = missing & self.old.keys()
            self.young.update(zip(again, map(self.old.__getitem__, again)))
            missing -= again
        return missing


class _Stretch(dict):
    """A state of the forward pass: the longest stretch before here that lies in a piece. Next character -> next state.

    ``ends`` has (length, piece, what may stand before it) of the pieces that
    the stretch ends with, longest first; a last character counts as one.
    """

    __slots__ = ("text", "of", "ends")

    def __init__(self, text: str, of: "Pieces"):
        super().__init__()
        self.text, self.of = text, of
        ends = (text[i:] for i in range(len(text)))
        self.ends = tuple((len(p), p, of.follows(p)) for p in ends if len(p) == 1 or p in of.ids)

    def __missing__(self, character: str) -> "_Stretch":
        text = self.text + character
        while len(text) > 1 and text not in self.of.inside:
            text = text[1:]
        self[character] = state = self.of.state(text)
        return state


class Pieces:
    """A model's pieces, and what the forward pass needs to know of them."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int, bpe: bool,
                 special: set[int] = frozenset()):
        self.names, self.byte_ids, self.unknown, self.bpe = pieces, byte_ids, unknown, bpe
        self.special = set(special)
        hidden = self.special | set(byte_ids.values())
        self.ids = {p: i for i, p in enumerate(pieces) if i not in hidden}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.bytes_of = {i: b for b, i in byte_ids.items()}
        self.rank = {p: -s for p, s in self.scores.items() if len(p) > 1}
        self.halves: dict[str, tuple[str, str]] = {}
        self.known = _Memory()
        self.blobs = {p: array("i", [i]).tobytes() for p, i in self.ids.items()}
        self.spoken: list[bytes] = []
        #: Every stretch of a piece: what isn't one of these lies in no piece.
        self.inside = {p[i:j] for p in self.ids for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        self.forget()
        #: Runs of letters, digits, line ends and other signs stand apart unless a piece spans their border. The few
        #: such pieces are told by their rarest character; a part that holds it stays whole.
        spanning = {max(p) for p in self.ids if len(p) > 1 and len(_RUNS.findall(p)) != 1}
        self.whole = re.compile("[" + re.escape("".join(spanning)) + "]") if 0 < len(spanning) <= 16 else None
        self.by_runs = len(spanning) <= 16

    def forget(self) -> None:
        """Start the states anew."""
        self.stretches: dict[str, _Stretch] = {}
        self.may_follow: dict[str, _Follows] = {}
        self.start = _Stretch("", self)

    def state(self, text: str) -> _Stretch:
        if text not in self.stretches:
            self.stretches[text] = _Stretch(text, self)
        return self.stretches[text]

    def follows(self, piece: str) -> _Follows:
        if piece not in self.may_follow:
            self.may_follow[piece] = _Follows(piece, self.rank, self.split)
        return self.may_follow[piece]

    def cut(self, part: str) -> list[str]:
        return _RUNS.findall(part) if self.by_runs and not (self.whole and self.whole.search(part)) else [part]

    @classmethod
    def load(cls, model: str) -> "Pieces":
        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        pieces, scores = [lib.id_to_piece(i) for i in range(n)], [lib.get_score(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)}
        # A BPE model's scores are the negative places of its merges; unigram scores are logarithms.
        plain = [s for i, s in enumerate(scores) if i not in special and i not in byte_ids.values() and s > -1e8]
        return cls(pieces, scores, byte_ids, lib.unk_id(), all(s == int(s) for s in plain), special)

    def merged(self, word: str) -> list[str]:
        """Plain BPE: the best adjacent pair first, leftmost of equals."""
        rank, parts, n = self.rank.get, list(word), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(r, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a + b)) is not None]
        heapify(waiting)
        while waiting:
            _, at, piece = heappop(waiting)
            right = after[at]
            if right >= n or parts[at] is None or parts[at] + parts[right] != piece:
                continue  # one of the two is part of another piece by now
            parts[at], parts[right] = piece, None
            after[at] = right = after[right]
            if right < n:
                before[right] = at
                if (r := rank(piece + parts[right])) is not None:
                    heappush(waiting, (r, at, piece + parts[right]))
            left = before[at]
            if left >= 0 and (r := rank(parts[left] + piece)) is not None:
                heappush(waiting, (r, left, parts[left] + piece))
        return [p for p in parts if p is not None]

    def split(self, piece: str) -> tuple[str, str]:
        """The two halves whose merge makes the piece."""
        if piece not in self.halves:
            parts, top = list(piece), self.rank[piece]
            while len(parts) > 2:
                ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
                i = min(range(len(ranks)), key=lambda k: (ranks[k], k))
                if ranks[i] >= top:
                    break
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else ("", "")
        return self.halves[piece]

    def _forward(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Each word, in order, with its pieces."""
        scores, bpe = self.scores, self.bpe
        floor = min(scores.values(), default=0.0) - 10
        # One entry per prefix of the word before: its last piece, its score, and the state.
        last, best, states, before = [""], [0.0], [self.start], ""
        for word in words:
            shared, common = 0, min(len(word), len(before))
            while shared < common and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1:], best[shared + 1:], states[shared + 1:]
            state, end = states[shared], shared
            for character in word[shared:]:
                end += 1
                state = state[character]
                states.append(state)
                if bpe:
                    for size, piece, may_follow in state.ends:  # longest first; just one may follow what is before it
                        if size == end or may_follow[last[end - size]]:
                            break
                    last.append(piece)
                else:
                    top, piece = max((best[end - size] + scores.get(p, floor), p) for size, p, _ in state.ends)
                    last.append(piece)
                    best.append(top)
            parts, end = [], len(word)
            while end:
                parts.append(last[end])
                end -= len(last[end])
            before = word
            yield word, parts[::-1]

    def _ids(self, parts: list[str]) -> bytes:
        try:
            return b"".join(map(self.blobs.__getitem__, parts))
        except KeyError:
            return b"".join([self.blobs.get(part) or self._bytes(part) for part in parts])

    def _bytes(self, part: str) -> bytes:
        """Ids of what is no piece."""
        return array("i", [self.byte_ids[b] for b in part.encode("utf-8")] if self.byte_ids else [self.unknown]).tobytes()

    def learn(self, parts: set[str]) -> None:
        """Encode the marked parts that aren't known yet: their distinct words, sorted."""
        if len(self.stretches) > KEPT_STATES:
            self.forget()
        self.known.turn()
        new, several = set(), {}
        for part in self.known.unknown(parts):
            if part[1:].isalpha() or len(runs := self.cut(part)) == 1:
                new.add(part)
            else:
                several[part] = runs
        new |= self.known.unknown({w for runs in several.values() for w in runs})
        known = self.known.young
        # Runs of marks have merges of equal rank, which pairs can't tell apart; they are few and merged plainly.
        marks = [w for w in new if w.startswith(MARK * 2)] if self.bpe else []
        for word in marks:
            known[word] = self._ids(self.merged(word))
        for word, found in self._forward(sorted(new.difference(marks))):
            known[word] = self._ids(found)
        for part, runs in several.items():
            known[part] = b"".join([known[w] for w in runs])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian signed 32-bit ids of each text."""
        cut = []
        for text in texts:
            marked = (MARK + text.replace(" ", MARK)) if text else ""
            # Single marks: what lies between two of them is a part by itself. Runs of marks need a closer look.
            cut.append(_WORDS.findall(marked) if MARK * 2 in marked else [MARK + x for x in marked[1:].split(MARK)] if text else [])
        self.learn({part for parts in cut for part in parts})
        known = self.known.young.__getitem__
        return [b"".join(map(known, parts)) for parts in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for marks without the first, byte pieces as UTF-8; control pieces are silent."""
        if not self.spoken:
            self.spoken = [bytes([self.bytes_of[i]]) if i in self.bytes_of else b"" if i in self.special else name.encode("utf-8")
                           for i, name in enumerate(self.names)]
        parts = map(self.spoken.__getitem__, ids)
        text = b"".join(parts).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def pieces(model: str = MODEL) -> Pieces:
    """This worker's pieces of the model file (its path is a parameter; it lies on every machine)."""
    held = worker_cache()
    if ("pieces", model) not in held:
        held["pieces", model] = Pieces.load(model)
    return held["pieces", model]


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of docs: id, ids array<int>.

    Null and empty texts have no ids. Repeated rows and null ids give a row
    each; an empty table gives no rows. Marks in a text count as blanks, as in
    the library.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model)
        for batch in batches:
            at = 0
            for part in portions(texts_of(batch), PORTION_CHARS):
                encoded = known.encode_batch(part)
                ends = np.cumsum([0, *(len(x) // 4 for x in encoded)])
                ids = pa.array(np.frombuffer(b"".join(encoded), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=[id, "ids"])
                at += len(part)

    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, ids array<int>")


def decode(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", model: str = MODEL, keep_ids: bool = False) -> DataFrame:
    """One row per row: id, text (and ids). Null ids give an empty text."""
    kind = encoded.schema[id].dataType.simpleString()
    names = [id, *(["ids"] if keep_ids else []), "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model)
        for batch in batches:
            lists = batch.column(1)
            ids, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            # One row's ids at a time: as Python numbers those of a whole batch would be hundreds of MB.
            texts = pa.array((known.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(1)] if keep_ids else []), texts], names=names)

    return encoded.select(id, ids).mapInArrow(run, f"{id} {kind}, {'ids array<int>, ' if keep_ids else ''}text string")


ship(__name__)
