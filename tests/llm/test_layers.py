"""Secrets in layers of escapes against a walk over every layer, character by
character, and in streams of any length."""

import base64
import random
import re
import resource
import time
import zlib
from urllib.parse import unquote

import pytest

from colloquy.llm import secrets

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"(?:\\u[0-9a-fA-F]{4})+")


def undone(chars, pattern, decode):
    """``chars``: (character, first place, last place) of a layer."""
    text, out, at = "".join(c for c, _, _ in chars), [], 0
    for m in pattern.finditer(text):
        out += chars[at : m.start()]
        got, own = decode(m[0]), chars[m.start() : m.end()]
        even = len(own) == 3 * len(got)
        out += [(c, own[3 * k][1] if even else own[0][1], own[3 * k + 2][2] if even else own[-1][2]) for k, c in enumerate(got)]
        at = m.end()
    return out + chars[at:]


def every_layer(text):
    """Spans of all layers that undoing either kind of escape reaches."""
    start = [(c, k, k + 1) for k, c in enumerate(text)]
    found, seen, work = set(), set(), [start]
    while work:
        chars = work.pop()
        own = "".join(c for c, _, _ in chars)
        if own in seen:
            continue
        seen.add(own)
        found |= {(chars[a][1], chars[b - 1][2], kind) for a, b, kind in secrets.base_spans(own)}
        work.append(undone(chars, URL, lambda x: unquote(x, errors="replace")))
        work.append(undone(chars, ESCAPED, secrets._unescape))
    return found


def spans(text, **more):
    return {(s, e, k) for s, e, k, _ in secrets.scan(text, **more)[1]}


EATEN = [
    "x %255Cu0123456789abcdef%25301234567 y",  # a later step takes four digits of a match
    "x %5Cu0123456789abcdef01234567 y",
    "token=%2561bc%25%36%34ef \\u005cu0061%32",
    "a %2525252541b " + "%" + "25" * 30 + "0123456789abcdef01234567",
]


@pytest.mark.parametrize("text", EATEN)
def test_every_layer_is_scanned(text):
    assert spans(text) == every_layer(text)


def test_a_match_of_a_middle_layer():
    assert spans(EATEN[0]) == {(8, 36, 2)}


def test_random_chains():
    rng = random.Random(12)
    pieces = ["%25", "%5C", "\\u0025", "\\u005c", "%", "\\", "u00", "25", "5C", "41", "0123456789abcdef01234567", "token=", "AKIA" + "Q" * 16, "%61", "\\u0061", " ", "abc123", "%3D", "secret", "u0123"]
    hit = 0
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(2, 14)))
        want = every_layer(text)
        hit += len(want) > len(secrets.base_spans(text))
        assert spans(text) == want, text
    assert hit > 300


def test_streams_without_a_parting_byte():
    """A match is found wherever it stands, also across pieces."""
    secret = "token=abc123"
    for before, gap in ((0, 0), (65_530, 0), (65_536 - 4_000, 9_000), (300_001, 0)):
        inside = "x" * before + "_token" + " " * gap + secret[5:] + "y" * 200_000
        text = "say " + base64.b64encode(zlib.compress(inside.encode())).decode() + " end"
        assert {k for _, _, k in spans(text, most_bytes=1 << 16)} == {0}, (before, gap)
    digits = "say " + base64.b64encode(zlib.compress(b"z" * 65_520 + b"0123456789abcdef01234567" + b"z" * 99_999)).decode()
    assert {k for _, _, k in spans(digits, most_bytes=1 << 16)} == {2}


def test_huge_streams_take_bounded_memory():
    packer = zlib.compressobj(9)
    data = b"".join([packer.compress(b"x" * (1 << 24)) for _ in range(32)] + [packer.compress(b" token=abc123 "), packer.flush()])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    assert {k for _, _, k in spans("x " + base64.b64encode(data).decode())} == {0}
    assert time.perf_counter() - began < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_deep_chains_end():
    began = time.perf_counter()
    assert (0, 100_006, 2) not in spans("%" + "25" * 50_000 + "41")
    deep = "%" + "25" * 200 + "61bc0123456789abcdef01234"
    assert any(k == 2 and s == 0 for s, _, k in spans(deep))
    assert time.perf_counter() - began < 60


DEEP = [
    "%" + "25" * 300 + "61bc0123456789abcdef01234",
    "token=ab%" + "25" * 200 + "61bc x %" + "25" * 90 + "3Dabc \\u005c" + "u005c" * 20 + "u0061 end",
    "&#38;" + "#38;" * 250 + "#97;bc token&#38;" + "#38;" * 200 + "#61;abcdef",
]


@pytest.mark.parametrize("text", DEEP)
def test_every_layer_of_deep_chains_is_scanned(text, monkeypatch):
    monkeypatch.setitem(globals(), "ESCAPED", secrets._ESCAPE)
    assert spans(text) == every_layer(text)


def test_every_layer_of_a_very_deep_chain():
    """Each of 50,000 layers ends in another run of digits."""
    began = time.perf_counter()
    text = "%" + "25" * 50_000 + "41"
    assert spans(text) == {(k, len(text), 2) for k in range(1, len(text) - 23, 2)}
    assert time.perf_counter() - began < 20


def test_base64_of_a_middle_layer():
    """A run that stands in the 301st layer only: the next one takes its beginning for an escape."""
    run = base64.b64encode(b"secret=abcdef").decode()
    assert run.startswith("c2Vj")
    text = "%" + "25" * 300 + "5Cxc2V%" + "25" * 300 + "6A" + run[4:] + " end"
    (span,) = {x for x in spans(text) if x[2] == 0}
    assert text[span[0] : span[1]] == text[text.index("c2V") : text.index("=")]


def test_random_chains_with_short_stretches_put_away(monkeypatch):
    monkeypatch.setattr(secrets, "_AHEAD", 12)
    monkeypatch.setattr(secrets, "_LONG", 24)
    monkeypatch.setattr(secrets, "_B64_RUN", bytes([48]) * 256)  # escapes only
    monkeypatch.setattr(secrets._Tail, "unwrapped", lambda *_: ())
    rng = random.Random(13)
    pieces = ["0123456789abcdef01234567", "token=", "AKIA" + "Q" * 16, "%61", "\\u0061", " ", " ab cd ", "abc123", "%3D", "\\u003d", "secret", "AKIA" * 14, "token=token=secret=abcdef"]
    for _ in range(1500):
        chains = ["%" + "25" * rng.randrange(40), "\\u005c" + "u005c" * rng.randrange(12)]
        text = "".join(rng.choice(chains if rng.random() < 0.4 else pieces) for _ in range(rng.randrange(2, 8)))
        assert spans(text) == every_layer(text), text
