"""Secret scans with a recursive decoding worklist.

The base patterns run over the whole text. Then a worklist unwraps layers:
URL escapes, Unicode escapes, base64 runs, and zlib or gzip data inside base64.
A decoded layer goes on the list, unless its content has been seen in this
document (cycles end), and is scanned again; what a content holds is mapped
back to code points of the document from every place where it stands. A row
needs only its own text, so the work is one scan with no shuffle.

Each undoing of URL escapes or of Unicode escapes is a layer of its own, which
is scanned before its escapes are undone in turn, to any depth. Of a layer only
what the step changed is scanned, as far as a match or a base64 run can reach;
all else stood in an earlier layer. Of a long stretch that a chain of escapes
eats from the left, only what its new beginning gives is looked at. Where
chains of both kinds stand in one stretch without a parting character, each
pair of depths is a layer of its own.

A base64 run, also one wrapped over lines, is decoded at all four alignments.
Bytes that are not text part a layer but do not drop it; UTF-16 is read too.
Zlib, gzip, bz2, xz and raw deflate streams are unpacked in pieces of about
``most_bytes``, parted where no match can be, so none is left out for its size.
A piece without such a place is parted anyway; the next one begins again with
its end, a sixteenth of ``most_bytes``, with long gaps of spaces made short, so
that any match in a stream of any length is whole in some piece.

Defined results: null text is empty; null doc_ids are carried through;
repeated rows repeat; extra columns are ignored; an empty table gives an empty
result. A stream inside a base64 run inside a stream is read as far as its
piece goes.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import cached_property
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds, in order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

_HEX_RUN = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_B64_RUN = bytes(49 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else 48 for b in range(256))
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\U[0-9a-fA-F]{8}|\\u\{[0-9a-fA-F]{1,6}\}|&#x[0-9a-fA-F]{1,6};|&#[0-9]{1,7};)+")
#: One escape, or a few in a row.
_FEW = re.compile(r"(?:%[0-9A-Fa-f]{2}){1,16}|" + _ESCAPE.pattern[:-1] + "{1,16}")
_BEGUN = re.compile(r"(?:%[0-9A-Fa-f]?|\\(?:[ux][0-9a-fA-F]{0,3}|U[0-9a-fA-F]{0,7}|u\{[0-9a-fA-F]{0,6})?|&(?:#(?:x[0-9a-fA-F]{0,6}|[0-9]{0,7}))?)\Z")
_PARTS = re.compile(r"\\u\{[0-9a-fA-F]+\}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\U[0-9a-fA-F]{8}|&#x?[0-9a-fA-F]+;")
_ONE = re.compile(r"[0-9a-fA-F]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
_LEAST = 12  # characters of the shortest match, token= and six more
_STRETCH = re.compile(rb"[\t\n\r -~]{%d}" % _LEAST)
_UTF16 = re.compile(rb"(?:[\t\n\r -~]\0){%d,}" % _LEAST), re.compile(rb"(?:\0[\t\n\r -~]){%d,}" % _LEAST)
_PACKED = re.compile(rb"(?s)(?=(\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0|[\x08\x18\x28\x38\x48\x58\x68\x78].))")
_PARTING = bytes(49 if re.match(rb"[!$()*,<>?@\[\]^`|~\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\xff]", bytes([b])) else 48 for b in range(256))
_GAP = re.compile(rb" {65,}")
_APART = re.compile(rb"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\xff]")
#: What a match or a base64 run can hold, and what an escape can hold beside it.
#: A character of the private planes stands for a stretch put away.
_PRIVATE, _MOST_TAILS = 0xF0000, 0x20000
_HELD = re.compile(r"""[\t\n\r "'+\-./0-9:=A-Z_a-z\U000f0000-\U0010ffff]+""")
_PLAIN = re.compile(r"""[\t\n\r "'+\-./0-9:=A-Z_a-z#;{}]+""")
_UNIT = re.compile(r"""[\t\n\r "'+\-./0-9:=A-Z_a-z#;{}%\\&]+""")
#: Between two words with no escape in the first, no match and no run goes on.
_BETWEEN = re.compile(r"(?<= )[A-Za-z0-9+/_.-]+ +(?=[A-Za-z0-9+/_.-])")
_NEAR = re.compile(r"[%\\&][^%\\&\U000f0000-\U0010ffff]{0,11}[\U000f0000-\U0010ffff]")
_AHEAD, _LONG = 24, 128  # characters brought out of a stretch at a time; the shortest put away
_STARTS = re.compile(f"(?=({ASSIGN.pattern}))"), re.compile(f"(?=({ACCESS.pattern}))")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start, then kind. Cheap byte
    searches decide which patterns can match at all; they lose nothing."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = []
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"1" * 24 in raw.translate(_HEX_RUN):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _unescape(run: str) -> str:
    out = []
    for part in _PARTS.findall(run):
        digits = _ONE.search(part[2:].lstrip("x"))[0]
        base = 10 if part.startswith("&#") and part[2] not in "xX" else 16
        code = int(digits, base)
        out.append(chr(code) if code < 0x110000 else "\ufffd")
    joined = "".join(out)
    return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _readable(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, its first byte, bytes a character). The patterns are ASCII, so
    other bytes only need to part what stands beside them; under ``_LEAST``
    readable characters in a row nothing can match."""
    if _STRETCH.search(data):
        yield data.decode("ascii", "replace"), 0, 1
    if b"\0" in data:
        for pattern, low in ((_UTF16[0], 0), (_UTF16[1], 1)):
            for m in pattern.finditer(data):
                yield m[0][low::2].decode("ascii"), m.start(), 2


def _unpackers(data: bytes, whole: bool) -> Iterator[tuple[int, object]]:
    """(first byte, decompressor) of what may be a compressed stream; raw
    deflate has no mark and is only tried on a ``whole`` run."""
    for m in _PACKED.finditer(data):
        head = m[1]
        if head[:1] == b"\x1f":
            yield m.start(), zlib.decompressobj(31)
        elif head[:1] == b"B":
            yield m.start(), bz2.BZ2Decompressor()
        elif head[:1] == b"\xfd":
            yield m.start(), lzma.LZMADecompressor()
        elif not (head[0] * 256 + head[1]) % 31 and not head[1] & 32:
            yield m.start(), zlib.decompressobj(15)
    if whole:
        yield 0, zlib.decompressobj(-15)


def _parted(held: bytes) -> int:
    """Where ``held`` can be parted last, 0 if nowhere."""
    return max(held.translate(_PARTING).rfind(b"1") + 1, held.rfind(b"\0\0") + 2 if b"\0\0" in held else 0)


def _inflate(data: memoryview, unpacker, most: int) -> Iterator[bytes]:
    """The stream in pieces of about ``most`` bytes, parted where no pattern
    and no run can be, else with an overlap. A stream that breaks off gives
    what came before."""
    held, again, rest, step = b"", 0, data, min(most, 1 << 20)
    zip_like = hasattr(unpacker, "unconsumed_tail")
    while not unpacker.eof:
        try:
            got = unpacker.decompress(rest, step)
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            break
        rest = unpacker.unconsumed_tail if zip_like else b""
        if not got and (not rest if zip_like else unpacker.needs_input):
            break
        held += got
        if len(held) - again >= most:
            if cut := _parted(held):
                yield held[:cut]
                held, again = held[cut:], 0
            else:
                yield held
                held = (_GAP.sub(b" " * 64, held) if b" " * 65 in held else held)[-(most // 16) :]
                again = len(held)
    if len(held) > again or not again:
        yield held


class _Map:
    """Places of a decoded text in what it came from: copied stretches, and
    decoded ones, a character of which is ``stride`` wide, or the whole (0)."""

    def __init__(self):
        self.out, self.source, self.end, self.stride, self.n = [], [], [], [], 0
        self.parts: list[str] = []

    def add(self, text: str, start: int, end: int, copied: bool = False) -> None:
        if text:
            self.parts.append(text)
            self.out.append(self.n)
            self.source.append(start)
            self.end.append(end)
            self.stride.append(1 if copied else 3 if end - start == 3 * len(text) else 0)
            self.n += len(text)

    def text(self) -> str:
        return "".join(self.parts)

    def __call__(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.out, a) - 1, bisect_right(self.out, b - 1) - 1
        first = self.source[i] + self.stride[i] * (a - self.out[i])
        last = self.source[j] + self.stride[j] * (b - self.out[j]) if self.stride[j] else self.end[j]
        return first, last


def _decoded(escapes: str) -> str:
    return unquote(escapes, errors="replace") if escapes[0] == "%" else _unescape(escapes)


def _begun(text: str, least: int, end: int) -> int:
    """Where the escapes begin, one in the other, that may go on at ``end``."""
    while m := _BEGUN.search(text, least, end):
        end = m.start()
    return end


def _settled(text: str) -> _Map:
    """Escapes undone until none is left, without the layers between; scans do
    not use it. A place looks ahead a few characters
    only, and each step takes in some of them, so time is linear."""
    got, at = _Map(), 0
    while m := _FEW.search(text, at):
        # What stands before may be the beginning of an escape.
        start = _begun(text, max(at, m.start() - 24), m.start())
        got.add(text[at:start], at, start, True)
        held, piece, at = text[start : m.start()] + _decoded(m[0]), m.start(), m.end()
        while True:
            inner = _FEW.search(look := held + text[at : at + 12])
            if inner and inner.start() < len(held):
                first = _begun(look, max(0, inner.start() - 24), inner.start())
                got.add(held[:first], start, at)
                taken = max(inner.end() - len(held), 0)
                held, at = look[first : inner.start()] + _decoded(inner[0]) + look[inner.end() : len(held)], at + taken
                continue
            # An escape may have begun that the next escapes of the text go on with.
            first, after = _begun(held, max(0, len(held) - 24), len(held)), _FEW.match(text, at)
            if first == len(held) or not after:
                break
            got.add(held[:first], start, at)
            held, start, piece, at = held[first:] + _decoded(after[0]), piece, at, after.end()
        got.add(held, start, at)
    got.add(text[at:], at, len(text), True)
    return got


class _Barren:
    """A raw deflate stream that is unpacked in one go with nothing to read, and
    its state at each ``step``. One that begins alike, as far as it does, has
    nothing to read either; its end is unpacked from the last state before."""

    def __init__(self, data: bytes, most: int, step: int = 4096):
        self.data, self.most, self.states = data, most, []
        unpacker, size, end = zlib.decompressobj(-15), 0, b""
        for k in range(0, len(data) - step, step):
            got = unpacker.decompress(data[k : k + step])
            size, end = size + len(got), (end + got)[-32:]
            self.states.append((k + step, unpacker.copy(), size, end))

    def begins(self, data: bytes) -> bool:
        """Whether ``data`` is known to have nothing to read."""
        i = bisect_left(self.states, True, key=lambda x: not self.data.startswith(data[: x[0]]) or x[0] > len(data))
        if not i:
            return False
        at, unpacker, size, end = self.states[i - 1]
        try:
            got = unpacker.copy().decompress(data[at:], self.most - size)
        except zlib.error:
            return True
        return size + len(got) < self.most and not any(_readable(end + got))


class _Tail:
    """A long stretch of a layer that later layers cut from the left. What
    matches at a place depends on what follows it, so tables of the whole
    stretch give the matches of each of its ends."""

    def __init__(self, text: str, first: array, last: array):
        self.text, self.first, self.last = text, first, last
        self.told: set = set()
        self.decoded: dict = {}
        self.barren = [_Barren(b"", 0)] * 2

    @cached_property
    def matches(self) -> list[tuple[list[int], list[tuple[int, bool]]]]:
        """Of assign and access: where one can start; its end, and whether it is long enough."""
        found = [[m.span(1) + (len(m[m.re.groups]) >= least,) for m in pattern.finditer(self.text)] for pattern, least in zip(_STARTS, (6, 20), strict=True)]
        return [([a for a, _, _ in x], [x[1:] for x in x]) for x in found]

    @cached_property
    def digits(self) -> list[tuple[int, int]]:
        return [m.span() for m in HEX.finditer(self.text)]

    @cached_property
    def runs(self) -> list[list[re.Match]]:
        """Base64 runs, and wrapped ones."""
        return [list(pattern.finditer(self.text)) for pattern in (_BASE64, _WRAPPED)]

    def run(self, m: re.Match) -> tuple[_Run, list[bytes]]:
        """A run and its bytes at each alignment."""
        if m.span() not in self.decoded:
            run = _Run(m)
            self.decoded[m.span()] = run, [run.data(shift) for shift in range(4)]
        return self.decoded[m.span()]

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.first[a], self.last[b - 1]

    def spans(self, cut: int) -> Iterator[tuple[int, int, int]]:
        """Spans of the end from ``cut`` on, but for those given before."""
        for kind, (starts, ends) in enumerate(self.matches):
            at = cut
            while (i := bisect_left(starts, at)) < len(starts) and (kind, i) not in self.told:
                self.told.add((kind, i))
                at, enough = ends[i]
                if enough:
                    yield (*self.span(starts[i], at), kind)
        i = bisect_right(self.digits, (cut, len(self.text))) - 1
        if i >= 0 and self.digits[i][1] - cut >= 24:
            yield (*self.span(cut, self.digits[i][1]), 2)
        while (i := i + 1) < len(self.digits) and (2, i) not in self.told:
            self.told.add((2, i))
            yield (*self.span(*self.digits[i]), 2)

    def unwrapped(self, cut: int, most: int) -> Iterator[tuple[str, Callable | None, tuple[int, int]]]:
        """What the base64 runs hold that begin where ``cut`` parts a longer run.
        Their bytes are ends of the longer run's bytes, which were looked at; new
        is what stands before the first byte that parts, and raw deflate."""
        for wrapped, runs in enumerate(self.runs):
            i = bisect_right(runs, cut, key=re.Match.start) - 1
            if i < 0 or cut >= (end := runs[i].end()) or not (m := _BASE64.match(self.text, cut, cut + 16) or wrapped and _BASE64.search(self.text, cut, end)):
                continue
            (run, aligned), start = self.run(runs[i]), m.start()
            if (wrapped, "run", start) in self.told or wrapped and not run.goes_on(start):
                continue
            self.told.add((wrapped, "run", start))
            o, whole = bisect_left(run.place, start), self.span(start, end)
            for shift in range(4):
                data, k = aligned[(o + shift) % 4], (o + shift) // 4 * 3
                part = _APART.search(data, k)
                for s, first, size in _readable(data[k : part.start() if part else len(data)]):
                    where = run.mapped(o + shift, first, size)
                    yield s, (lambda a, b, where=where: self.span(*where(a, b))), whole
                if not shift and not self.barren[wrapped].begins(data := data[k:]):
                    size, held = 0, False
                    for piece in _inflate(memoryview(data), zlib.decompressobj(-15), most):
                        size += len(piece)
                        for s, _, _ in _readable(piece):
                            held = True
                            yield s, None, whole
                    if 0 < size < min(most, 1 << 20) and not held:
                        self.barren[wrapped] = _Barren(data, min(most, 1 << 20))


class _Steps:
    """Every layer of escapes of a text. A layer is a text and the first and
    last place of each character; one character, with its place in the stretch
    instead, stands for the rest of a long plain stretch. A step undoes one kind
    of escapes once, and only what it changed is looked at, out to a character
    that no match and no run holds."""

    def __init__(self, most: int):
        self.most, self.tails, self.known, self.told = most, [], {}, set()

    def short(self, text: str, first: array, last: array) -> tuple[str, array, array]:
        """Long plain stretches put away, but for the characters ahead."""
        out, a, b, at = [], array("q"), array("q"), 0
        for m in _PLAIN.finditer(text):
            if m.end() - m.start() <= _LONG or len(self.tails) >= _MOST_TAILS:
                continue
            stretch, cut = slice(*m.span()), m.start() + _AHEAD
            key = _mark(m[0], first[stretch], last[stretch])
            if key not in self.known:
                self.known[key] = len(self.tails)
                self.tails.append(_Tail(m[0], first[stretch], last[stretch]))
            out += [text[at:cut], chr(_PRIVATE + self.known[key])]
            a += first[at:cut]
            b += last[at:cut]
            a.append(_AHEAD)
            b.append(-1)
            at = m.end()
        return ("".join(out) + text[at:], a + first[at:], b + last[at:]) if at else (text, first, last)

    def ahead(self, text: str, first: array, last: array) -> tuple[str, array, array]:
        """Characters brought out where an escape may reach into a stretch put away."""
        at = 0
        while m := _NEAR.search(text, at):
            at, k = m.start(), m.end() - 1
            tail, cut = self.tails[ord(text[k]) - _PRIVATE], first[k]
            more = min(cut + _AHEAD, len(tail.text))
            left = more < len(tail.text)
            text = text[:k] + tail.text[cut:more] + (text[k] if left else "") + text[k + 1 :]
            first = first[:k] + tail.first[cut:more] + array("q", [more] * left) + first[k + 1 :]
            last = last[:k] + tail.last[cut:more] + array("q", [-1] * left) + last[k + 1 :]
        return text, first, last

    def long(self, text: str, first: array, last: array) -> tuple[str, Callable]:
        """Stretches put away brought out whole, the last one to where it parts;
        and the span of a span of that, read where the places are kept."""
        out, parts, at, n = [], [], 0, 0
        for k in (*(k for k, j in enumerate(last) if j < 0), len(text)):
            out.append(text[at:k])
            parts.append((n, first, last, at))
            n, at = n + k - at, k + 1
            if k < len(text):
                tail, i = self.tails[ord(text[k]) - _PRIVATE], first[k]
                end = len(tail.text) if at < len(text) else m.end() if (m := _HELD.match(tail.text, i)) else i
                out.append(tail.text[i:end])
                parts.append((n, tail.first, tail.last, i))
                n += end - i

        def place(k: int, side: int) -> int:
            part = parts[bisect_right(parts, k, key=lambda x: x[0]) - 1]
            return part[side][part[3] + k - part[0]]

        return "".join(out), lambda a, b: (place(a, 1), place(b - 1, 2))

    def undone(self, pattern: re.Pattern, text: str, first: array, last: array) -> tuple[tuple[str, array, array], list[tuple[int, int]]]:
        """The next layer, and what changed in it."""
        out, a, b, changed, at = [], array("q"), array("q"), [], 0
        for m in pattern.finditer(text):
            start, end = m.span()
            got = "".join([c if ord(c) < _PRIVATE else "\ufffd" for c in _decoded(m[0])])
            a += first[at:start]
            b += last[at:start]
            changed.append((len(a), len(a) + len(got)))
            even = end - start == 3 * len(got)
            a += first[start:end:3] if even else array("q", [first[start]]) * len(got)
            b += last[start + 2 : end : 3] if even else array("q", [last[end - 1]]) * len(got)
            out += [text[at:start], got]
            at = end
        return ("".join(out) + text[at:], a + first[at:], b + last[at:]), changed

    def __call__(self, text: str) -> Iterator[tuple]:
        for m in _UNIT.finditer(text):
            at = m.start()
            for end in (*(x.end() for x in _BETWEEN.finditer(text, at, m.end())), m.end()):
                if _URL.search(text, at, end) or _ESCAPE.search(text, at, end):
                    yield from self.every(text[at:end], at)
                at = end

    def every(self, text: str, start: int) -> Iterator[tuple]:
        places = array("q", range(start, start + len(text) + 1))
        layer = self.ahead(*self.short(text, places[:-1], places[1:]))
        work, seen = deque([(layer, 1)]), {_mark(*layer)}
        while work:
            layer, depth = work.popleft()
            for pattern in (_URL, _ESCAPE):
                if not pattern.search(layer[0]):
                    continue
                after, changed = self.undone(pattern, *layer)
                for part in self.parts(after[0], changed):
                    yield from self.looked(depth, *(x[part] for x in after))
                after = self.ahead(*self.short(*after))
                if (mark := _mark(*after)) not in seen:
                    seen.add(mark)
                    work.append((after, depth + 1))

    def parts(self, text: str, changed: list[tuple[int, int]]) -> Iterator[slice]:
        """The stretches that match or run may hold at what changed."""
        upto = 0
        for a, b in changed:
            if b <= upto:
                continue
            a = max(a, upto)
            while a > upto and _HELD.match(text, a) and _HELD.match(text, a - 1):
                a -= 1
            upto = m.end() if (m := _HELD.match(text, b)) else b
            for m in _HELD.finditer(text, a, upto):
                yield slice(*m.span())

    def looked(self, depth: int, text: str, first: array, last: array) -> Iterator[tuple]:
        if (mark := _mark(text, first, last)) in self.told:
            return
        self.told.add(mark)
        if last[-1] < 0:
            tail, cut = self.tails[ord(text[-1]) - _PRIVATE], first[-1]
            begin = cut - len(text) + 1
            own = slice(max(begin, 0), cut)
            if (tail.text[own], tail.first[own], tail.last[own]) == (text[:-1], first[:-1], last[:-1]):
                yield list(tail.spans(begin)), None, None, False, depth
                for layer in tail.unwrapped(begin, self.most):
                    yield (*layer, True, depth + 1)
                return
        text, where = self.long(text, first, last)
        if len(text) >= _LEAST:
            yield text, where, where(0, len(text)), False, depth


def _layers(text: str, most: int, escapes: bool = True) -> Iterator[tuple]:
    """(decoded, map, whole span, whether its escapes are still to be undone,
    layers between): ``map`` gives the span in ``text`` of a span of the decoded
    one; None where only the whole span is known. A list instead of a decoded
    text holds spans in ``text``."""
    if escapes and ("%" in text and _URL.search(text) or ("\\" in text or "&#" in text) and _ESCAPE.search(text)):
        yield from _Steps(most)(text)
    if b"1" * 16 in text.encode("utf-8", "surrogatepass").translate(_B64_RUN):
        for m in (*_BASE64.finditer(text), *_WRAPPED.finditer(text)):
            for layer in _unwrapped(m, most):
                yield (*layer, True, 1)


class _Run:
    """A base64 run, its bytes at an alignment, and the places of what they hold."""

    def __init__(self, m: re.Match):
        one_line = not any(c in m[0] for c in "\r\n\t ")
        self.run = "".join(m[0].split()).rstrip("=").replace("-", "+").replace("_", "/")
        self.place = range(m.start(), m.start() + len(self.run)) if one_line else array("q", (m.start() + k for k, c in enumerate(m[0]) if c not in "=\r\n\t "))
        self.last_line = m.start() + m[0].rfind("\n")

    def data(self, shift: int) -> bytes:
        part = self.run[shift : len(self.run) - ((len(self.run) - shift) % 4 == 1)]
        try:
            return base64.b64decode(part + "=" * (-len(part) % 4), validate=True)
        except (binascii.Error, ValueError):
            return b""

    def goes_on(self, at: int) -> bool:
        """Whether more lines follow that of ``at``."""
        return at < self.last_line

    def mapped(self, shift: int, first: int, size: int) -> Callable:
        byte = lambda k: first + size * k
        return lambda a, b: (self.place[shift + byte(a) * 4 // 3], self.place[min(len(self.run), shift - (-byte(b) * 4 // 3)) - 1] + 1)


def _unwrapped(m: re.Match, most: int) -> Iterator[tuple[str, Callable | None, tuple[int, int]]]:
    """What a base64 run holds. It may begin anywhere in the run, so all four
    alignments are decoded; four characters stand for three bytes."""
    run = _Run(m)
    for shift in range(4):
        if not (data := run.data(shift)):
            continue
        for s, first, size in _readable(data):
            yield s, run.mapped(shift, first, size), m.span()
        for first, unpacker in _unpackers(data, not shift):
            span = (run.place[shift + first * 4 // 3], m.end())
            for piece in _inflate(memoryview(data)[first:], unpacker, most):
                for s, _, _ in _readable(piece):
                    yield s, None, span


def _mark(text: str, *places: array) -> bytes:
    got = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16)
    for x in places:
        got.update(x)
    return got.digest()


def scan(text: str | None, most_bytes: int = 1 << 24) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """(base spans, all spans with the layer that they came from)."""
    text = text or ""
    base = base_spans(text)
    number = {(_mark(text), True): 0}  # a content is decoded once, wherever it stands
    own, within = [dict.fromkeys(base, 0)], [[]]  # spans of a content, with the layers in it that they came through
    work = [(0, _layers(text, most_bytes))]
    while work:
        outer, layers = work[-1]
        if (got := next(layers, None)) is None:
            work.pop()
            continue
        decoded, where, whole, escapes, steps = got
        if isinstance(decoded, list):
            for x in decoded:
                own[outer][x] = min(steps, own[outer].get(x, steps))
            continue
        inner = number.setdefault((_mark(decoded), escapes), len(own))
        if inner == len(own):
            own.append(dict.fromkeys(base_spans(decoded), 0))
            within.append([])
            work.append((inner, _layers(decoded, most_bytes, escapes)))
        within[inner].append((outer, where, whole, steps))
    # Each span goes out to every place of its content, the fewest layers first.
    out = deque([(k, x) for k, spans in enumerate(own) if k for x in spans])
    while out:
        inner, (a, b, kind) = out.popleft()
        for outer, where, whole, steps in within[inner]:
            depth = own[inner][a, b, kind] + steps
            at = (*(where(a, b) if where is not None else whole), kind)
            if depth < own[outer].get(at, depth + 1):
                own[outer][at] = depth
                if outer:
                    out.append((outer, at))
    return base, sorted(((s, e, k, d) for (s, e, k), d in own[0].items()), key=lambda x: (x[0], x[2], x[1]))


def find_secrets(docs: DataFrame, most_bytes: int = 1 << 24) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end, depth); depth 0 is
    the text itself. ``base`` holds what the base patterns find."""
    entry = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            base, spans = [], []
            for t in b.column(1):
                own, every = scan(t.as_py(), most_bytes)
                base.append([{"kind": KINDS[k], "start": s, "end": e, "depth": 0} for s, e, k in own])
                spans.append([{"kind": KINDS[k], "start": s, "end": e, "depth": d} for s, e, k, d in every])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(entry)), pa.array(spans, pa.list_(entry))], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long,depth:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, f"doc_id long, base {kind}, spans {kind}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_secrets``."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
