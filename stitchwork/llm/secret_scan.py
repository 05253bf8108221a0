"""Secret scans through nested encodings.

A worklist of layers per text: the text itself, then whatever URL escapes,
Unicode escapes, base64 runs and compressed base64 runs it unwraps to, each
scanned and unwrapped in turn until nothing new appears. A layer that was seen
before at the same place is not followed again, so cycles end. Every match is
mapped back to the span of the original text that holds it.

Bytes that aren't plain text are read all the same: invalid bytes and control
characters stand between what can match, UTF-16 is told by its zero bytes, and
a run of base64 is read from each of its first four characters, as letters may
be glued to it. Compressed layers of any size are read as a stream of windows.
What stays unread for the limits below is counted, and redacted as a whole.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.llm.common import ship, texts_of

KINDS = ("assign", "access", "hex")
#: Compressed layers are scanned in windows of so many bytes, cut at a blank; neighbours share a quarter or 64 KiB.
WINDOW_BYTES = 1 << 24
OVERLAP_BYTES = 1 << 16
#: What the compressed runs of one text may unpack to in all. A run beyond that, or one whose window has no blank to cut
#: at in its second half, is counted in ``bombs``; ``redact`` replaces it as a whole.
MAX_UNPACKED_BYTES = 1 << 30
CHUNK_BYTES = 1 << 16
#: To tell compressed bytes from others by unpacking their beginning (a bzip2 block has up to 900,000 bytes).
PEEK_BYTES = 1 << 20
MARK = "[secret]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{60,}\r?\n)*[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines of any width, indented or not; of such a run, its lines.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Inside a run that isn't base64 as a whole: what stands between dashes, or between slashes.
_PARTS = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"), re.compile(r"[A-Za-z0-9]{16,}={0,2}"))
#: An escaped percent sign, ampersand or backslash may be escaped many times over; such a chain is one escape.
_ESCAPE, _NEXT = "%(?:25)*", "%(?:25)*[89ABab][0-9A-Fa-f]"
#: Escaped UTF-8, valid sequences only, by their first byte. Other bytes stay as they are.
_URL = re.compile("(?:" + "|".join(_ESCAPE + x for x in (
    "[0-7][0-9A-Fa-f]", f"(?:[Cc][2-9A-Fa-f]|[Dd][0-9A-Fa-f]){_NEXT}", f"[Ee]0{_ESCAPE}[ABab][0-9A-Fa-f]{_NEXT}",
    f"[Ee][1-9A-Ca-cE-Fe-f]{_NEXT}{_NEXT}", f"[Ee][Dd]{_ESCAPE}[89][0-9A-Fa-f]{_NEXT}",
    f"[Ff]0{_ESCAPE}[9ABab][0-9A-Fa-f]{_NEXT}{_NEXT}", f"[Ff][1-3]{_NEXT}{_NEXT}{_NEXT}", f"[Ff]4{_ESCAPE}8[0-9A-Fa-f]{_NEXT}{_NEXT}")) + ")+")
_URL_BYTE = re.compile(_ESCAPE + "([0-9A-Fa-f]{2})")
_UNICODE = re.compile(r"\\(?:u005[cC])*(?:u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U00[01][0-9A-Fa-f]{5}"
                      r"|u\{[0-9A-Fa-f]{1,6}\}|x[0-9A-Fa-f]{2})|&(?:#38;)*(?:#[0-9]{1,7};|#[xX][0-9A-Fa-f]{1,6};)")
_CHAINS = (re.compile(r"\\(?:u005[cC])+(?=[uUx])"), re.compile(r"&(?:#38;)+(?=#)"))
_PRINTABLE = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f�]*")
#: The shortest secret is ``token=`` and 8 characters, and no escape is shorter than what it stands for: bytes without so
#: many readable ones in a row hold none. The same with a zero byte behind each (the last may lack it) is UTF-16.
_READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{14}")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){13}")
#: Where compressed members start inside other bytes: gzip, bzip2, xz.
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_STANDARD = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain patterns in one layer, by start and kind."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _LONG.search(text):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """A text and the span of the original behind each of its characters (or one span behind all)."""

    def __init__(self, text: str, low=None, high=None, whole: tuple[int, int] | None = None):
        self.text, self.low, self.high, self.whole = text, low, high, whole

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (self.low[start], self.high[end - 1]) if self.low is not None else (start, end)

    def replaced(self, pattern: re.Pattern, decode) -> "_Layer | None":
        """The layer with every match decoded, or None if nothing decodes."""
        parts, low, high, at, changed = [], [], [], 0, False

        def copy(start: int, end: int) -> None:
            parts.append(self.text[start:end])
            if not self.whole:
                low.extend(range(start, end) if self.low is None else self.low[start:end])
                high.extend(range(start + 1, end + 1) if self.high is None else self.high[start:end])

        for match in pattern.finditer(self.text):
            text = decode(match.group())
            if text is None:
                continue
            changed = True
            copy(at, match.start())
            at = match.end()
            parts.append(text)
            if not self.whole:
                start, end = self.span(match.start(), match.end())
                low.extend([start] * len(text))
                high.extend([end] * len(text))
        if not changed:
            return None
        copy(at, len(self.text))
        return _Layer("".join(parts), *((None, None, self.whole) if self.whole else (low, high)))


def _url(run: str) -> str:
    return bytes.fromhex("".join(_URL_BYTE.findall(run))).decode("utf-8")


def _unicode(escape: str) -> str | None:
    escape = _CHAINS[escape[0] == "&"].sub(lambda _: escape[0], escape)
    digits = re.findall(r"[0-9A-Fa-f]+", escape[2:] if escape[0] == "\\" else escape[2:].lstrip("xX"))
    number = int(digits[0], 16 if escape[0] == "\\" or escape[2] in "xX" else 10)
    if len(digits) == 2:
        number = 0x10000 + ((number - 0xD800) << 10) + int(digits[1], 16) - 0xDC00
    return chr(number) if 0 < number < 0x110000 and not 0xD800 <= number < 0xE000 else None


def _unpacker(data: bytes):
    """A decompressor for what the bytes start with, or None."""
    head = bytes(data[:6])
    if head[:2] == b"\x1f\x8b" or len(head) > 2 and head[0] & 15 == 8 and int.from_bytes(head[:2]) % 31 == 0:
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head == b"\xfd7zXZ\x00" else None


def _unpacked(source: Iterator[bytes], unpack=None) -> Iterator[bytes]:
    """Chunks of what one compressed member after the other holds, then what follows the last. Ends where one is broken.

    ``unpack`` reads the first member; else its beginning tells.
    """
    data, first = next(source, b""), True
    while True:
        while len(data) < 6 and (more := next(source, b"")):
            data = bytes(data) + more
        unpack = unpack or _unpacker(data)
        if unpack is None:
            break
        first = False
        try:
            while not unpack.eof:
                out = unpack.decompress(data, CHUNK_BYTES)
                if out:
                    yield out
                data = getattr(unpack, "unconsumed_tail", b"")
                if not out and not data and not unpack.eof and not (data := next(source, b"")):
                    return
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            return
        data, unpack = unpack.unused_data.lstrip(b"\x00"), None
    if data and not first:
        yield bytes(data)
        yield from source


def _unwrapped(data: bytes, raw: bool = False) -> Iterator[bytes] | None:
    """Chunks of what compressed bytes hold, through layers directly inside each other until one repeats; None if not compressed."""
    source, seen = iter([data]), set()
    while True:
        head = bytearray()
        while len(head) < PEEK_BYTES and (more := next(source, b"")):
            head += more
        head, mark = bytes(head), hashlib.sha256(head).digest()
        unpack = zlib.decompressobj(-15) if raw else _unpacker(head)
        if unpack is None or mark in seen or not next(_unpacked(iter([head]), unpack), b""):
            return chain([head], source) if seen else None
        seen.add(mark)
        source, raw = _unpacked(chain([head], source), zlib.decompressobj(-15) if raw else None), False


def _readings(data: bytes) -> list[str]:
    """The texts that bytes may stand for, if they can hold a secret: UTF-8 with marks for other bytes, and UTF-16."""
    found = [data.decode("utf-8", "replace")] if _READABLE.search(data) else []
    if wide := _WIDE.search(data):
        data = data[wide.start() % 2:]
        found.append((data + b"\x00" * (len(data) % 2)).decode("utf-16-le", "replace"))
    return found


def _bytes(body: str, skip: int = 0) -> bytes:
    """The bytes of base64 without its padding, from one of its characters on; a single last character holds none."""
    size = len(body) - skip
    body = body[skip:len(body) - (size % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _inside(run: str) -> tuple[list[str], list[Iterator[bytes]], bool]:
    """Texts in a base64 run, streams of what it unpacks to, and whether all of it is plain or compressed text for sure."""
    body = "".join(run.split()).rstrip("=").translate(_STANDARD)
    texts, streams = [], []
    for skip in range(min(4, len(body))):
        try:
            data = _bytes(body, skip)
        except (binascii.Error, ValueError):
            return texts, streams, False
        if not skip and len(body) % 4 != 1:
            try:
                text = data.decode("utf-8")
                if _PRINTABLE.fullmatch(text) and (stream := _unwrapped(data)) is None:
                    return [text], [], True
            except UnicodeDecodeError:
                pass
            if (stream := _unwrapped(data)) is not None:
                return [], [stream], True
        for at in chain([0] if skip or len(body) % 4 == 1 else [], (m.start() for m in _PACKED.finditer(data))):
            if (stream := _unwrapped(memoryview(data)[at:])) is not None:
                streams.append(stream)
                break
        else:
            if (stream := _unwrapped(data, raw=True)) is not None:
                streams.append(stream)
        texts += _readings(data)
    return texts, streams, False


def _wrapped(text: str) -> list[tuple[int, int, list[str], list[Iterator[bytes]]]]:
    """(start, end, texts, streams) of base64 that is wrapped over lines.

    The lines around a run may be words of the text, and one run may follow another. So all lines are tried, then those
    without the first or last; then each group of lines of one width with the shorter line that ends it. Where none of
    these is text for sure, what all lines may stand for is taken.
    """
    found = []

    def tried(lines: list[tuple[int, int]]) -> bool:
        if len(lines) < 2 or sum(e - s for s, e in lines) < 16:
            return False
        start, end = lines[0][0], lines[-1][1]
        texts, streams, sure = _inside(text[start:end])
        known = [x for s, e, inside, _ in found if s <= start and end <= e for x in inside]
        if sure and not (texts and any(texts[0] in x for x in known)):
            found.append((start, end, texts, streams))
        return sure

    for match in _WRAPPED.finditer(text):
        lines = [m.span() for m in _LINE.finditer(text, *match.span())]
        sizes = [e - s for s, e in lines]
        groups, at = [], 0
        while at < len(lines):
            end = at + 1
            while end < len(lines) and sizes[end] == sizes[at]:
                end += 1
            groups.append((at, end, end < len(lines) and sizes[end] < sizes[at]))
            at = end
        n = len(found)
        any(tried(lines[i:j]) for i in (0, 1) for j in (len(lines), len(lines) - 1))
        if len(groups) > 1:
            if len(groups) > 2:
                found[n:] = [x for x in found[n:] if not x[3]]  # compressed runs are unpacked by group
            for at, end, more in groups:
                if not (more and tried(lines[at:end + 1])):
                    tried(lines[at:end])
        if len(found) == n and sum(sizes) >= 16:
            texts, streams, _ = _inside(match.group())
            if texts or streams:
                found.append((*match.span(), texts, streams))
    return found


class _Text:
    """The scan of one text: what was found, what stays unread, and the layers still to look at."""

    def __init__(self, text: str):
        self.base = base_spans(text)
        self.spans, self.unread, self.seen, self.left = set(self.base), set(), set(), MAX_UNPACKED_BYTES
        work: list[_Layer | Iterator[_Layer]] = [_Layer(text)]
        while work:
            layer = work.pop()
            if not isinstance(layer, _Layer):  # a stream: its next window, the rest later
                stream, layer = layer, next(layer, None)
                if layer is None:
                    continue
                work.append(stream)
            mark = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.whole
            if mark not in self.seen:
                self.seen.add(mark)
                if layer.low is not None or layer.whole:
                    for start, kind, end in base_spans(layer.text):
                        low, high = layer.span(start, end)
                        self.spans.add((low, kind, high))
                work += self.inner(layer)

    def windows(self, stream: Iterator[bytes], span: tuple[int, int]) -> Iterator["_Layer"]:
        held = bytearray()
        for data in chain(stream, [b""]):
            self.left -= len(data)
            if self.left < 0:
                self.unread.add(span)
                data = b""
            held += data
            if data and len(held) < WINDOW_BYTES:
                continue
            for text in _readings(bytes(held)):
                yield _Layer(text, whole=span)
            if not data:
                return
            cut = held.rfind(b" ", len(held) // 2)
            if cut < 0:
                self.unread.add(span)
                cut = len(held)
            del held[:max(1, cut - min(OVERLAP_BYTES, WINDOW_BYTES // 4))]

    def inner(self, layer: "_Layer") -> list["_Layer | Iterator[_Layer]"]:
        """The layers directly inside one."""
        found, text = [], layer.text
        if "%" in text:
            found.append(layer.replaced(_URL, _url))
        if "\\" in text or "&#" in text:
            found.append(layer.replaced(_UNICODE, _unicode))

        def take(start: int, end: int, texts: list[str], streams: list[Iterator[bytes]]) -> None:
            span = layer.span(start, end)
            found.extend(_Layer(x, whole=span) for x in texts)
            found.extend(self.windows(x, span) for x in streams)

        wrapped = _wrapped(text) if "\n" in text else []
        for run in wrapped:
            take(*run)
        if _LONG.search(text):
            for match in _BASE64.finditer(text):
                around = [x for x in wrapped if x[0] <= match.start() and match.end() <= x[1]]
                if any(streams for *_, streams in around):
                    continue
                texts, streams, sure = _inside(match.group())
                if not (sure and texts and any(texts[0] in x for _, _, known, _ in around for x in known)):
                    take(*match.span(), texts, streams)
                if not sure and not match.group().rstrip("=").isalnum():
                    for part in {x.span() for p in _PARTS for x in p.finditer(text, *match.span())} - {match.span()}:
                        take(*part, *_inside(text[slice(*part)])[:2])
        return [x for x in found if x is not None]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (base ones and those of inner layers), and the number of bombs."""
    found = _Text(text)
    return found.base, sorted(found.spans), len(found.unread)


def cleaned(text: str) -> str:
    """The text without its secrets and without the runs that stay unread."""
    found = _Text(text)
    return redacted(text, [*found.spans, *((low, len(KINDS), high) for low, high in found.unread)])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = MARK) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    parts, at, until = [], 0, -1
    for start, _, end in sorted(spans):
        if start >= until:
            if until >= 0:
                at = until
            parts += [text[at:start], mark]
            until = end
        until = max(until, end)
    return "".join(parts) + text[max(until, 0):] if spans else text


SCHEMA = "n_assign long, n_access long, n_hex long, base_spans string, spans string, bombs long, redacted string"


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex (plain matches), base_spans, spans (kind:start:end in code
    points, end exclusive, by start and kind), bombs, redacted (the cleaned text if ``with_text``, else null).

    Null and empty texts have no span; a null text stays null when redacted.
    Repeated rows and null ids give a row each. An empty table gives no rows.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(7)]
            for raw, value in zip(batch.column(1).to_pylist(), texts_of(batch)):
                base, spans, bombs = scan(value)
                kinds = [k for _, k, _ in base]
                clean = (None if raw is None else cleaned(value)) if with_text else None
                for column, x in zip(columns, (kinds.count(0), kinds.count(1), kinds.count(2), _joined(base),
                                               _joined(spans), bombs, clean)):
                    column.append(x)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=t) for c, t in zip(columns, types)]],
                names=[id, "n_assign", "n_access", "n_hex", "base_spans", "spans", "bombs", "redacted"])

    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, {SCHEMA}")


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """docs with every found span replaced by a mark; no row goes. Columns and their order are those of docs.

    The rows stream through Python once, whole, so nothing is joined back.
    ``size``, where docs has it, follows the changed texts.
    """
    names = docs.columns
    at = names.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).to_pylist()
            clean = [x if x is None else cleaned(x) for x in raw]
            arrays = list(batch.columns)
            arrays[at] = pa.array(clean, type=batch.schema.field(at).type)
            if size in names and pa.types.is_integer(batch.schema.field(names.index(size)).type):
                k = names.index(size)
                arrays[k] = pa.array([n if a == b else len(b) for n, a, b in zip(batch.column(k).to_pylist(), raw, clean)],
                                     type=batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    return found.select(id, "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "bombs")


ship(__name__)
