"""Secret scans: a recursive decoding worklist over each whole text.

Layer 0 is the text.  Every layer is scanned for the three kinds of secrets;
then it is unwrapped: percent escapes (``%uXXXX`` too), escapes of string
literals (``\\u``, ``\\u{}``, ``\\U``, ``\\x``, octal and short ones such as
``\\"``), character references, two-byte characters, base64 runs (standard and
URL alphabets, any offset, also over line breaks), and gzip / zlib data inside
any of these.  Each child layer joins the worklist unless its content was seen before (cycle
detection), until nothing new appears (fixpoint).  Decoded bytes are scanned
whatever they hold, one character a byte (Latin-1): all patterns are ASCII,
so this finds the same as UTF-8 and loses nothing.  Every layer carries the
span of the original text that each of its characters came from, so a hit in
any layer is reported as a span of the text (code points, end exclusive).

Compressed data is opened to its end, all members of it, and up to the fault
if it is damaged.  Its content is scanned in pieces cut where no match, escape,
base64 run or inner compressed data can reach across, so results are those of
the whole; memory follows the longest stretch without such a place.

Null counts as empty; a text without secrets gives zero counts and empty
strings; an empty table gives no rows.  Rows are independent: repeated rows
give repeated results.  Input columns named like an output column are replaced.
Not opened: raw deflate without a header, bz2, xz, zlib windows below 32K.
"""

from __future__ import annotations

import base64
import hashlib
import html
import itertools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from rankshift.llm.common import add_columns

KINDS = ("assign", "access", "hex")
# Fixed patterns of the three kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%u[0-9A-Fa-f]{4}|%[0-9A-Fa-f]{2})+")
_HEXED = r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}"
_ESCAPES = re.compile(rf"(?:{_HEXED})+")
# The same with the short and octal escapes of string literals (printed bytes, JSON inside JSON).
_LITERAL = re.compile(rf"""(?:{_HEXED}|\\[0-3]?[0-7]{{1,2}}|\\[abfnrtv\\'"/])+""")
_UNIT = re.compile(r"""\\(u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[0-3]?[0-7]{1,2}|[abfnrtv\\'"/])""")
_SHORT = {c: ord(v) for c, v in zip("abfnrtv\\'\"/", "\a\b\f\n\r\t\v\\'\"/")}
_ENTITY = re.compile(r"(?:&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|amp|lt|gt|equals|colon|sol|plus|period|lowbar|num);)+")
# Two bytes a character, either order.
_WIDE = re.compile("(?:[\\t\\n\\r -~]\0){6,}|(?:\0[\\t\\n\\r -~]){6,}")
# Base64 letters, over line breaks (and the indent around them) too.
_BASE64 = re.compile(r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-]{1,15}[ \t]*[\r\n])
                         [A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}""", re.VERBOSE)
_LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_STANDARD = bytes.maketrans(b"-_", b"+/")
_PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
# What a decoded run needs to have for a hit or for a further layer.
_LIVE = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%u?[0-9A-Fa-f]{2}|\\[uUx0-7abfnrtv\\'\"/]|&#|&[a-z]{2,6};|"
                   rb"(?:[ -~]\0){6}|(?:\0[ -~]){6}|"
                   rb"[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t]*[\r\n]|\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
STEP, PIECE = 1 << 16, 1 << 20  # bytes read from compressed data, bytes of content looked at, at a time
# Bytes where content may be cut: not in any pattern, escape, wrapped base64 or start of compressed data.
_CUT = np.ones(256, bool)
_CUT[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
                   b"+/_.=-\"' :%\\\r\n\t!~*(){}&#;\0\x1f\x8b\x08", np.uint8)] = False


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the undecoded text, sorted."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _fixed(places) -> bool:
    """Whether all characters of a layer have one place (content of compressed data)."""
    return places.strides == (0,)


def _replace(text: str, lo, hi, pattern, decode):
    """Child layer with every run of ``pattern`` decoded, or None if nothing changed."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        got = decode(m.group())
        s, e = m.span()
        parts += [text[at:s], got]
        if not _fixed(lo):
            starts += [lo[at:s], np.full(len(got), lo[s])]
            ends += [hi[at:s], np.full(len(got), hi[e - 1])]
        at = e
    if not parts:
        return None
    new = "".join([*parts, text[at:]])
    if _fixed(lo):
        return new, np.broadcast_to(lo[0], len(new)), np.broadcast_to(hi[0], len(new))
    return new, np.concatenate([*starts, lo[at:]]), np.concatenate([*ends, hi[at:]])


def _percent(run: str) -> str:
    return _from_units(int(x.lstrip("u"), 16) for x in run.split("%")[1:])


def _entities(run: str) -> str:
    return "".join(html.unescape(x + ";") for x in run.split(";")[:-1])


def _from_units(units) -> str:
    """One character a unit; half a surrogate pair, or a number beyond all characters, becomes a mark of its own."""
    return "".join("\ufffd" if 0xD800 <= u < 0xE000 or u > 0x10FFFF else chr(u) for u in units)


def _escapes(run: str) -> str:
    return _from_units(_SHORT[x] if x in _SHORT else int(x[1:].strip("{}"), 16) if x[0] in "uUx" else int(x, 8)
                       for x in _UNIT.findall(run))


def _stream(data: bytes, at: int):
    """Content of the gzip or zlib data at ``at`` bit by bit: (content, end of the input used, state).

    State: "more", "whole" (its end) or "bad" (a fault).  Members that follow are part of the content."""
    d, size = zlib.decompressobj(47), STEP  # either header
    while True:
        part, keep = data[at:at + size], d.copy() if size > 1 else None
        try:
            got = d.decompress(part, PIECE if size > 1 else 1)
        except zlib.error:
            if size == 1:
                yield b"", at, "bad"
                return
            d, size = keep, max(1, size >> 4)  # again in smaller steps: all content before the fault counts
            continue
        at += len(part) - len(d.unused_data if d.eof else d.unconsumed_tail)
        if d.eof:
            yield got, at, "whole"
            if not _PACKED.match(data, at):
                return
            d, size = zlib.decompressobj(47), STEP
        elif got or part:
            yield got, at, "more"
        else:
            return


def _extent(data: bytes, at: int) -> tuple[int, int, str]:
    """(size of the content, end, state) of the compressed data at ``at``."""
    size, end, state, whole = 0, at, "more", None
    for got, end, state in _stream(data, at):
        size += len(got)
        whole = end if state == "whole" else whole
    # a fault after a whole member: what follows is not part of it
    return (size, whole, "whole") if state == "bad" and whole else (size, end, state)


def _cut(buf: bytes) -> int:
    """Last place where ``buf``, the content so far, can be cut; 0 if there is none."""
    limit, place = len(buf), np.arange(len(buf))
    todo, seen = [(buf.decode("latin-1"), place, place)], set()
    while todo:
        layer = todo.pop()
        if layer[0] in seen:
            continue
        seen.add(layer[0])
        todo += _respelled(*layer)
        data, at = layer[0].encode("latin-1", "replace"), 0
        while m := _PACKED.search(data, at):
            _, end, state = _extent(data, m.start())
            if state == "more" or (state == "whole" and end + 3 > len(data)):  # may go on after ``buf``
                limit = min(limit, int(layer[1][m.start()]))
                break
            at = end if state == "whole" else m.end()
    places = np.flatnonzero(_CUT[np.frombuffer(buf, np.uint8, limit)]) if limit else ()
    return int(places[-1]) + 1 if len(places) else 0


def _pieces(data: bytes, at: int):
    """The content of the compressed data at ``at`` in pieces that can be scanned alone."""
    parts, held, enough = [], 0, PIECE
    for got, _, _ in _stream(data, at):
        parts.append(got)
        held += len(got)
        if held >= enough:
            buf = b"".join(parts)
            cut = _cut(buf)
            if cut:
                yield buf[:cut]
            parts, held = [buf[cut:]], len(buf) - cut
            enough = max(PIECE, 2 * held)
    if held:
        yield b"".join(parts)


def _unwrap_base64(text: str, lo, hi):
    """Child layers of the base64 runs of one layer.

    Text before a run (a path, ``key_``) may consist of base64 letters, so a run is decoded at all four
    offsets: wherever the encoded part starts, one of them is in step with it.  Lines are decoded joined,
    and each alone, which keeps the place of what ends at a line's end exact."""
    for m in _BASE64.finditer(text):
        raw = np.frombuffer(m.group().encode(), np.uint8)
        size = np.count_nonzero(raw > 32)
        if size < 16:
            continue
        place = None if _fixed(lo) else m.start() + np.flatnonzero(raw > 32)
        if size < len(raw):
            for line in _LINE.finditer(text, m.start(), m.end()):
                yield from _decode_run(line.group().encode(), np.arange(*line.span()), 0, lo, hi)
        for offset in range(4):
            yield from _decode_run(raw[raw > 32].tobytes(), place, offset, lo, hi)


def _decode_run(run: bytes, place, offset: int, lo, hi):
    """The layer of one run of base64 letters at ``place``, decoded from ``offset``."""
    letters = run.rstrip(b"=").translate(_STANDARD)[offset:]
    if len(letters) % 4 == 1:  # the last letter holds no whole byte
        letters = letters[:-1]
    data = base64.b64decode(letters + b"=" * (-len(letters) % 4))
    if _LIVE.search(data):  # else neither a hit nor anything to unwrap
        if _fixed(lo):
            yield data.decode("latin-1"), np.broadcast_to(lo[0], len(data)), np.broadcast_to(hi[0], len(data))
            return
        first = offset + np.arange(len(data)) // 3 * 4
        yield data.decode("latin-1"), lo[place[first]], hi[place[np.minimum(first + 3, len(place) - 1)]]


def _unpack(text: str, lo, hi):
    """Child layers of the gzip and zlib data in a decoded layer.  A compressed byte has no place of its
    own: every character has the place of the whole compressed data."""
    data, at = text.encode("latin-1", "replace"), 0
    while m := _PACKED.search(data, at):
        size, end, state = _extent(data, m.start())
        at = end if state == "whole" else m.end()
        for piece in _pieces(data, m.start()) if size else ():
            yield (piece.decode("latin-1"), np.broadcast_to(lo[m.start()], len(piece)),
                   np.broadcast_to(hi[end - 1], len(piece)))


def _respelled(text: str, lo, hi):
    """Child layers with escapes decoded."""
    if "%" in text and (got := _replace(text, lo, hi, _PERCENT, _percent)):
        yield got
    if "\\" in text:
        for pattern in (_ESCAPES, _LITERAL):
            if got := _replace(text, lo, hi, pattern, _escapes):
                yield got
    if "&" in text and (got := _replace(text, lo, hi, _ENTITY, _entities)):
        yield got
    if "\0" in text and (got := _narrowed(text, lo, hi)):
        yield got


def _narrowed(text: str, lo, hi):
    """Child layer with two-byte characters made one; every character keeps its place."""
    keep = np.ones(len(text), bool)
    for m in _WIDE.finditer(text):
        first = m.start() + (text[m.start()] != "\0")
        keep[first:m.end():2] = False
    if keep.all():
        return None
    at = np.flatnonzero(keep)
    new = "".join(map(text.__getitem__, at.tolist()))
    if _fixed(lo):
        return new, np.broadcast_to(lo[0], len(new)), np.broadcast_to(hi[0], len(new))
    return new, lo[at], hi[at]


def _children(text: str, lo, hi):
    yield from _respelled(text, lo, hi)
    yield from _unwrap_base64(text, lo, hi)


def _mark(text: str, lo, hi) -> bytes:
    h = hashlib.blake2b(text.encode(), digest_size=16)
    for places in (lo, hi):
        h.update((places[:1] if _fixed(places) else places).tobytes())
    return h.digest()


def scan(text: str) -> tuple[list, list]:
    """(base matches, all spans), both as sorted (start, kind number, end)."""
    base = base_matches(text)
    spans = set(base)
    if "%" in text or "\\" in text or "&" in text or "\0" in text or _BASE64.search(text):
        place = np.arange(len(text))
        seen = set()
        work = [_children(text, place, place + 1)]  # one layer of each depth is held at a time
        while work:
            if (layer := next(work[-1], None)) is None:
                work.pop()
                continue
            mark = _mark(*layer)
            if mark in seen:
                continue
            seen.add(mark)
            found, lo, hi = layer
            spans |= {(int(lo[s]), k, int(hi[e - 1])) for s, k, e in base_matches(found)}
            work.append(itertools.chain(_children(*layer), _unpack(*layer)))
    return base, sorted(spans)


def _listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """``text`` with every maximal covered stretch replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus n_assign, n_access, n_hex (base matches), base, spans and redacted."""

    def make():
        def f(texts):
            cols = [[], [], [], [], [], []]
            for t in texts:
                base, spans = scan(t or "")
                kinds = [k for _, k, _ in base]
                for c, v in zip(cols, (*(kinds.count(k) for k in range(3)), _listed(base), _listed(spans),
                                       redact(t, spans) if spans else t)):
                    c.append(v)
            return cols
        return f

    names = [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base", "string"),
             ("spans", "string"), ("redacted", "string")]
    names = [(prefix + n, t) for n, t in names]
    return add_columns(docs.drop(*(n for n, _ in names)), make, names, text)


def op5(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    r = secret_scan(docs.select("doc_id", "text"))
    return r.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
