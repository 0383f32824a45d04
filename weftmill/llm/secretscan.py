"""Secret scans with a recursive decoding worklist.

The base patterns run on the whole text. Then a worklist unwraps what is encoded: URL escapes, or Unicode and numeric
character escapes, of the whole text in place; base64, also broken over lines, and compressed data (zlib, gzip, zstd)
within base64. Base64 is decoded at each of its four alignments, since what stands before it may be of
its alphabet; what it holds is read as UTF-8, or else as Latin-1. Compressed data may start anywhere in what was decoded,
may be several members long, and raw deflate is taken if it ends cleanly in readable text. Each new layer is scanned again
and unwrapped in turn, until nothing new turns up; a layer that was already seen at the same place is not taken again,
which ends cycles. A map from the layer's characters to the text's carries every find back to a span of the original text.

A text with escapes gives layers in place: its URL escapes decoded once, its character escapes decoded once, all of
them decoded until none is left (in one pass), and the links between: both kinds decoded once, twice, and so on. A link is not
made as a whole text: what differs from the link before is scanned and unwrapped as a layer, up to the next characters that no find can
contain. Where an escape gives another's beginning, what follows has only lost its first characters, so it shows a shorter
run of hexadecimal digits, or what its first characters hid; a long chain therefore costs its length.

The worklist is a stack of generators, so a layer is finished before the next one is made; base64 shrinks by a quarter for each
layer, so few are open at once. Decompression is streamed in segments that are cut only at a character which no
pattern, no encoded run and no wrapped block can contain: a small blob that swells costs time, and memory for its longest
stretch without such a character.

Kinds, in order: ``assign``, ``access``, ``hex``. Defined edge cases: a null text is empty; a very long text is scanned
whole; an empty table gives no rows; rows without an id and repeated rows are scanned like any other; of several finds at
one place each is listed; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from weftmill.llm.common import per_text, texts

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of at least 32
_WORDS = ("passw", "secret", "token", "api")
_URL = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
SEGMENT = 4 << 20
_BREAK = re.compile(rb"[^A-Za-z0-9+/=_.%\\&#;{}:\"'\s-]")  # in no encoded run, wrapped block or assignment
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
_PLAIN = re.compile(rb"[\x20-\x7e]{8}")


def scan(text: str) -> list[tuple[int, int, int]]:
    """Base finds as ``(start, kind number, end)`` in order."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text with, for each character, the span of the original that it comes from."""

    __slots__ = ("text", "low", "high", "in_place")

    def __init__(self, text: str, low: np.ndarray, high: np.ndarray, in_place: bool = False):
        self.text, self.low, self.high, self.in_place = text, low, high, in_place

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.low[start:end].min()), int(self.high[start:end].max())

    def part(self, text: str, first: np.ndarray, after: np.ndarray) -> Layer:
        """A layer whose character ``i`` stands for this layer's ``[first[i], after[i])``."""
        return Layer(text, self.low[first], self.high[after - 1])

    def decoded_in_place(self) -> Layer:
        return Layer(self.text, self.low, self.high, True)


def _decoded(layer: Layer, pattern: re.Pattern, value) -> Layer | None:
    """The text with each match replaced by its character or bytes; runs of bytes are read as UTF-8."""
    text, out, first, after, at = layer.text, [], array("q"), array("q"), 0
    if not pattern.search(text):
        return None
    pending: list[tuple[int, int, int]] = []  # escaped bytes: (byte, first, after)

    def flush() -> None:
        i = 0
        while i < len(pending):
            for n in (1, 2, 3, 4):
                try:
                    c = bytes(b for b, _, _ in pending[i : i + n]).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                break
            else:
                c, n = chr(pending[i][0]), 1
            out.append(c)
            first.append(pending[i][1])
            after.append(pending[min(i + n, len(pending)) - 1][2])
            i += n
        pending.clear()

    for m in pattern.finditer(text):
        if m.start() > at:
            flush()
            out.append(text[at : m.start()])
            first.extend(range(at, m.start()))
            after.extend(range(at + 1, m.start() + 1))
        v = value(m)
        if isinstance(v, int):
            pending.append((v, m.start(), m.end()))
        else:
            flush()
            out.append(v)
            first.append(m.start())
            after.append(m.end())
        at = m.end()
    flush()
    out.append(text[at:])
    first.extend(range(at, len(text)))
    after.extend(range(at + 1, len(text) + 1))
    return layer.part("".join(out), np.frombuffer(first, np.int64), np.frombuffer(after, np.int64))


def _character(m: re.Match) -> str:
    code = int(m[5]) if m[5] else int(next(g for g in m.groups()[:4] if g), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


_ANY = re.compile(_URL.pattern.replace("[0-9A-Fa-f]{2}", "([0-9A-Fa-f]{2})") + "|" + _ESCAPE.pattern)
_BEGINS = re.compile(r"[%\\&]")
_LONGEST = 10  # characters of the longest escape


def _code(m: re.Match) -> int:
    return int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)


def _settled(layer: Layer) -> Layer | None:
    """The text with all escapes decoded, and those that they make, until none is left; None if there is none."""
    text = layer.text
    if not _ANY.search(text):
        return None
    out: list[str] = []
    first, after = array("q"), array("q")
    front: list[tuple[str, int, int]] = []  # characters to be read again before the text goes on, the next one last
    at = 0

    def put(c: str, a: int, b: int) -> None:
        out.append(c)
        first.append(a)
        after.append(b)

    def read_again() -> None:
        """Take back from the output what could begin an escape together with what comes next."""
        tail = "".join(out[-_LONGEST + 1 :])[-_LONGEST + 1 :]
        if begin := _BEGINS.search(tail):
            for _ in range(len(tail) - begin.start()):
                whole = out.pop()
                if len(whole) > 1:
                    out.append(whole[:-1])
                front.append((whole[-1], first.pop(), after.pop()))

    while True:
        if front:
            ahead = "".join(c for c, _, _ in front[: -_LONGEST - 1 : -1]) + text[at : at + _LONGEST]
            m = _ANY.match(ahead)
            if m is None:
                put(*front.pop())
                continue
            size = m.end()
            taken = [front.pop() for _ in range(min(size, len(front)))]
            rest = size - len(taken)
            taken += [(text[i], i, i + 1) for i in range(at, at + rest)]
            at += rest
        else:
            m = _ANY.search(text, at)
            begin = m.start() if m else len(text)
            if begin > at:
                out.append(text[at:begin])
                first.extend(range(at, begin))
                after.extend(range(at + 1, begin + 1))
            if m is None:
                break
            taken = [(text[i], i, i + 1) for i in range(begin, m.end())]
            at = m.end()
        code = _code(m)
        if code >= 128:  # part of a longer character, or one that no escape contains: decoded below
            for c in taken:
                put(*c)
        else:
            made = (chr(code), min(a for _, a, _ in taken), max(b for _, _, b in taken))
            front.append(made)
            read_again()
    new = layer.part("".join(out), np.frombuffer(first, np.int64), np.frombuffer(after, np.int64))
    for pattern, value in ((_URL, lambda m: int(m[0][1:], 16)), (_ESCAPE, _character)):
        new = _decoded(new, pattern, value) or new
    return new


_WIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_.:\"'- \t\r\n\f\v")  # what finds and encoded runs are made of
_HEXES = re.compile(r"[0-9a-f]*")
_HEAD = 2048


def _quiet(head: str) -> bool:
    """Whether base64 that starts here, at any alignment, shows only what it shows further on: its first bytes are in no find,
    and are no raw deflate (by what ``_inflate`` asks of its first 4,096 bytes)."""
    if len(head) < 64 or head[0] in "pP":
        return False
    for skip in range(4):
        part = head[skip:].replace("-", "+").replace("_", "/")
        raw = base64.b64decode(part[: len(part) // 4 * 4])
        out = _BREAK.search(raw)
        if not out or out.start() >= 8:
            return False
        try:
            got = zlib.decompressobj(-15).decompress(raw, 4096)
        except zlib.error:
            continue
        if sum(not (32 <= c < 127 or c in (9, 10, 13) or c >= 128) for c in got) <= 0.05 * 4096:
            return False
    return True


def _links(layer: Layer) -> Iterator[Layer | tuple[int, int, int]]:
    """What the text shows when all its escapes are decoded once, twice, ...: layers around what changed, or finds.

    Characters are numbered: those of the text, its end, then those that escapes stand for; ``after`` and ``before`` differ from
    the text's order only where something was decoded.
    """
    text, n = layer.text, len(layer.text)
    if not _ANY.search(_ANY.sub(lambda m: chr(_code(m)) if _code(m) < 128 else "\x80", text)):
        return  # no chain: the layers decoded once show it
    made: list[str] = []
    low, high = array("q"), array("q")
    after: dict[int, int] = {}
    before: dict[int, int] = {}
    hexes, lines, quiet = (0, 0), (0, 0), {}

    def char(i: int) -> str:
        return text[i] if 0 <= i < n else made[i - n - 1] if i > n else "\0"

    def ends(i: int) -> tuple[int, int]:
        return (int(layer.low[i]), int(layer.high[i])) if i < n else (low[i - n - 1], high[i - n - 1])

    hits = [(m.start(), m.end() - 1, _code(m)) for m in _ANY.finditer(text)]  # first and last character
    while hits:
        new = []
        for a, b, code in hits:
            made.append(chr(code) if code < 128 else "\x80")
            low.append(ends(a)[0])
            high.append(ends(b)[1])
            i, left, right = n + len(made), before.get(a, a - 1), after.get(b, b + 1)
            before[i], after[i], after[left], before[right] = left, right, i, i
            new.append(i)
        covered: set[int] = set()
        for i in new:
            at = i
            if char(i) not in _WIDE:  # what follows has lost its first characters
                at = after[i]
                if 0 <= at < n:
                    if not hexes[0] <= at < hexes[1]:
                        hexes = at, _HEXES.match(text, at).end()
                    size, last = hexes[1] - at, hexes[1] - 1
                    if size > 0:
                        while (c := char(further := after.get(last, last + 1))) and c in "0123456789abcdef":
                            size, last = size + 1, further
                        if size >= 32:
                            yield ends(at)[0], 2, ends(last)[1]
                    if not lines[0] <= at < lines[1]:
                        run = _LINE.match(text, at)
                        lines = (at, run.end()) if run else (at, at)
                    head = text[at : min(at + _HEAD, lines[1])]
                    if head not in quiet:
                        if len(quiet) > 1000:
                            quiet.clear()
                        quiet[head] = _quiet(head)
                    if quiet[head]:
                        continue
            if at in covered or char(at) not in _WIDE:
                continue
            span = [at]
            while char(j := before.get(span[-1], span[-1] - 1)) in _WIDE:
                span.append(j)
            span.reverse()
            while char(j := after.get(span[-1], span[-1] + 1)) in _WIDE:
                span.append(j)
            covered.update(span)
            place = np.array([ends(j) for j in span])
            yield Layer("".join(map(char, span)), place[:, 0], place[:, 1], True)
        hits, begun = [], set()
        for i in new:  # an escape that is new holds a new character, and nothing that begins another
            begin = i
            for _ in range(_LONGEST):
                if begin < 0 or char(begin) in "%\\&":
                    break
                begin = before.get(begin, begin - 1)
            if begin < 0 or begin in begun or char(begin) not in "%\\&":
                continue
            begun.add(begin)
            follows = after.get(begin, begin + 1)
            if follows < n and (m := _ANY.match(char(begin) + text[follows : follows + _LONGEST - 1])):  # no character of it was decoded
                hits.append((begin, follows + m.end() - 2, _code(m)))
                continue
            ahead = [begin]
            while len(ahead) < _LONGEST and (j := after.get(ahead[-1], ahead[-1] + 1)) != n:
                ahead.append(j)
            if m := _ANY.match("".join(map(char, ahead))):
                hits.append((begin, ahead[m.end() - 1], _code(m)))


def _joined(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 broken over lines, joined, with the place of each character.

    A block is lines of one width, with a last one that may be shorter; whether the run before it and the one after it
    belong to it shows only when they are decoded, so each way is given.
    """
    for m in _WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(text, m.start(), m.end())]
        i = 0
        while i < len(lines):
            width, j = lines[i][1] - lines[i][0], i
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            for a, b in {(a, b) for a in (i, max(i - 1, 0)) for b in (j, min(j + 1, len(lines)))}:
                if b - a > 1 and sum(y - x for x, y in lines[a:b]) >= 16:
                    yield "".join(text[x:y] for x, y in lines[a:b]), np.concatenate([np.arange(x, y) for x, y in lines[a:b]])
            i = j


def _read(raw: bytes) -> tuple[str, np.ndarray]:
    """Decoded bytes as text, and the byte at which each character starts (with the end)."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1"), np.arange(len(raw) + 1)
    size = np.fromiter((len(c.encode()) for c in text), dtype=np.int64, count=len(text)) if not text.isascii() else np.ones(len(text), dtype=np.int64)
    return text, np.concatenate([[0], np.cumsum(size)])


def _streamed(feed) -> Iterator[bytes]:
    """Decompressed data in segments; a segment starts again at the last break of the one before."""
    tail = b""
    for got in feed:
        whole = tail + got
        yield whole
        at = None
        for at in _BREAK.finditer(whole, len(tail)):
            pass
        tail = whole[at.end() :] if at else whole


def _members(raw: bytes, wbits: int, used: list[int]) -> Iterator[bytes]:
    """What zlib makes of one member after another; stops at damage, after what came before it."""
    data = raw
    while data:
        engine = zlib.decompressobj(wbits)
        try:
            got = engine.decompress(data, SEGMENT)
            while got or engine.unconsumed_tail:
                used[0] = len(raw) - len(engine.unused_data)
                yield got
                got = engine.decompress(engine.unconsumed_tail, SEGMENT)
        except zlib.error:
            used[0] = len(raw)
            return
        if not engine.eof:
            used[0] = len(raw)
            return
        data = engine.unused_data
        used[0] = len(raw) - len(data)
        if wbits < 0 or not _MAGIC.match(data):
            return


def _frames(raw: bytes, used: list[int]) -> Iterator[bytes]:
    import io

    import zstandard

    used[0] = len(raw)
    try:
        reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
        while got := reader.read(SEGMENT):
            yield got
    except zstandard.ZstdError:
        return


def _inflate(raw: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Segments of the compressed data in ``raw``, each with the bytes ``[from, to)`` that it comes from."""
    at = _MAGIC.search(raw)
    while at:
        used = [0]
        some = False
        part = raw[at.start() :]
        for segment in _streamed(_frames(part, used) if at[0][:1] == b"\x28" else _members(part, 47, used)):
            some = True
            yield segment, at.start(), at.start() + (used[0] or len(part))
        at = _MAGIC.search(raw, at.start() + (max(used[0], 1) if some else 1))
    if raw:  # raw deflate has no mark: it must end cleanly, in readable text
        engine = zlib.decompressobj(-15)
        try:
            head = engine.decompress(raw, 4096)
        except zlib.error:
            return
        if (engine.eof or engine.unconsumed_tail) and len(head) >= 8 and sum(32 <= c < 127 or c in (9, 10, 13) or c >= 128 for c in head) >= 0.95 * len(head):
            used = [0]
            for segment in _streamed(_members(raw, -15, used)):
                yield segment, 0, used[0] or len(raw)


def unwrap(layer: Layer) -> Iterator[Layer | tuple[int, int, int]]:
    """The layers directly below one layer, and finds of layers that are not made."""
    text = layer.text
    if not layer.in_place:
        if "%" in text and (new := _decoded(layer, _URL, lambda m: int(m[0][1:], 16))):
            yield new.decoded_in_place()
        if ("\\" in text or "&#" in text) and (new := _decoded(layer, _ESCAPE, _character)):
            yield new.decoded_in_place()
        if ("%" in text or "\\" in text or "&#" in text) and (new := _settled(layer)):
            yield new.decoded_in_place()
            yield from _links(layer)
    for m in _BASE64.finditer(text):
        yield from _debased(layer, m[0].rstrip("="), np.arange(m.start(), m.end()))
    if "\n" in text:
        for code, place in _joined(text):
            yield from _debased(layer, code, place)


def _debased(layer: Layer, code: str, place: np.ndarray) -> Iterator[Layer]:
    """The layers in base64 whose characters stand at the given places, at each alignment."""
    plain = code.replace("-", "+").replace("_", "/")
    for skip in range(4):
        part = plain[skip:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        if len(part) < 8:
            return
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        own = place[skip:]
        if _PLAIN.search(raw):
            text, edge = _read(raw)
            begin, end = edge[:-1], edge[1:]
            last = np.minimum((end - 1) // 3 * 4 + 3, len(own) - 1)
            yield layer.part(text, own[begin // 3 * 4], own[last] + 1)
        for segment, first, after in _inflate(raw):
            inner = segment.decode("utf-8", "replace")
            n = len(inner)
            if n:
                low, high = layer.span(int(own[first // 3 * 4]), int(own[min(-(-after // 3) * 4, len(own)) - 1]) + 1)
                yield Layer(inner, np.broadcast_to(np.int64(low), n), np.broadcast_to(np.int64(high), n))


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``(base finds, all finds)`` of one whole text, each ``(start, kind number, end)`` in order."""
    text = text or ""
    base = scan(text)
    found = set(base)
    if "%" in text or "\\" in text or "&#" in text or _BASE64.search(text) or "\n" in text and _WRAPPED.search(text):
        place = np.arange(len(text) + 1)
        work, seen = [unwrap(Layer(text, place[:-1], place[1:]))], set()
        while work:
            layer = next(work[-1], None)
            if layer is None:
                work.pop()
                continue
            if isinstance(layer, tuple):
                found.add(layer)
                continue
            key = (hashlib.sha1(layer.text.encode("utf-8", "surrogatepass")).digest(), int(layer.low[0]), int(layer.high[-1]), layer.in_place) if layer.text else None
            if key and key not in seen:
                seen.add(key)
                for start, kind, end in scan(layer.text):
                    low, high = layer.span(start, end)
                    found.add((low, kind, high))
                work.append(unwrap(layer))
    return base, sorted(found)


def listed(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row."""

    def run(batch) -> dict:
        out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
        for t in batch.column("text").to_pylist():
            base, every = find(t)
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(b[1] == i for b in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(every))
        return {"doc_id": batch.column("doc_id"), **out}

    return per_text(texts(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
