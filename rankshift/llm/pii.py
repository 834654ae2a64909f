"""Personal data by anchor expansion.

One Aho-Corasick pass over each whole text finds anchors: at-signs in all
spellings, schemes (``mailto:``, ``tel:``, ``://[``), identifier cues (phone,
card, account, IBAN, IP) and the short digit pairs every number has.  A local
parser expands each anchor to the left and right, finds the exact boundaries
and validates them (octets, Luhn, IBAN check digits, label rules, IPv6
syntax).  Nothing else of the text is looked at, and a parser never reads a
stretch twice, so work is linear in the text.

Base spans are those of the four patterns of ``op12``, leftmost and not
overlapping within a kind; a match that fails its check is dropped and its
stretch used up.  The parsers add, in the same four kinds:

- email: ``[at]``/``(at)``/``%40``/``&#64;``/fullwidth at-signs with ``.``,
  ``[dot]`` or ``(dot)``; quoted local parts; non-ASCII local parts and
  domains; ``mailto:`` to a host without a dot; ``user@[1.2.3.4]``;
- ip: IPv6 addresses in ``://[...]``, behind an IP cue or around ``::``;
- card (payment accounts): IBANs and account numbers behind their cue, card
  numbers of 12 to 19 digits with other separators behind a card cue;
- phone: 7 to 15 digits behind a phone cue or a ``tel:``-like scheme.

Defined results: null counts as empty; a text without personal data gives
zero counts and empty strings; rows are independent, so repeated rows give
repeated results, and an empty table gives none.  Positions are code points,
end exclusive.  Input columns named like an output column are replaced.
"""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.llm.common import UPPER, add_columns

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Fixed forms of the base kinds, from an anchor on.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DIGITS = "0123456789"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What the parsers of other spellings accept.
_AT = ("@", "%40", "&#64;", "&commat;", "[at]", "(at)", "＠")
_DOT = r"(?:\.|\x20?[\[(]dot[\])]\x20?)"
_SPELT_DOMAIN = re.compile(rf"\x20?([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}})(?![A-Za-z0-9-])", re.I)
_WIDE_LOCAL = re.compile(r"(?<![\w.%+-])[\w%+-](?:[\w.%+-]*[\w%+-])?\Z")
_WIDE_DOMAIN = re.compile(r"(?!-)[\w-]+(?<!-)(?:\.(?!-)[\w-]+(?<!-))*\.[^\W\d_]{2,}")
_QUOTED = re.compile(r'"[^"\\\r\n]{1,62}"\Z')
_LITERAL = re.compile(r"\[([0-9A-Fa-f:.]{2,45})\]")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?")
_FILL = r"[\x20\t]*(?:(?:numbers?|num|no|nr|id)\b\.?)?[\x20\t]*[#:=]?[\x20\t]*"
_PHONE_CUE = re.compile(_FILL + r"(\+?\(?[0-9][\x20()./0-9-]*[0-9])(?![0-9A-Za-z])", re.I)
_TEL = re.compile(r"(\+?[0-9][().0-9-]*[0-9])")
_CARD_CUE = re.compile(_FILL + "([0-9](?:[\\x20./_ -]{0,2}[0-9])+)", re.I)
_ACCOUNT_CUE = re.compile(r"[\x20\t]*(?:(?:numbers?|num|no|nr)\b\.?[\x20\t]*[#:=]?|#)[\x20\t]*([0-9](?:[\x20-]?[0-9])+)(?![0-9A-Za-z])", re.I)
_IBAN_CUE = re.compile(_FILL + r"([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})(?![A-Za-z0-9])", re.I)
_IP_CUE = re.compile(r"[\x20\t]*(?:addr(?:ess)?\b)?[\x20\t]*[#:=]?[\x20\t]*([0-9A-Fa-f:.]{2,45})(?![0-9A-Za-z:])", re.I)
_HEXES = "0123456789abcdefABCDEF:."

# Identifier cues and schemes by what follows them; a word cue must not be the tail of a longer word.
CUES = {
    "phone": ("phone", "telephone", "tel", "mobile", "cell", "fax", "whatsapp", "telefon", "téléphone", "teléfono"),
    "card": ("card", "visa", "mastercard", "amex", "maestro"),
    "account": ("account", "acct", "konto", "cuenta", "compte"),
    "iban": ("iban",),
    "ipv6": ("ip", "ipv6"),
}
SCHEMES = {"mailto": ("mailto:",), "tel": ("tel:", "sms:", "callto:"), "host": ("://[",), "colons": ("::",)}


def anchors():
    """The automaton: every anchor with its tag and length."""
    import ahocorasick

    words = {"@": "at"}
    words |= {a: "spelt" for a in _AT[1:]}
    words |= {w: tag for table in (CUES, SCHEMES) for tag, ws in table.items() for w in ws}
    for a in _DIGITS:
        words["+" + a] = "plus"
        for b in _DIGITS:
            words[f"{a}.{b}"] = "dotted"
            words |= {a + sep + b: "digits" for sep in ("", " ", "-")}
    auto = ahocorasick.Automaton()
    for w, tag in words.items():
        auto.add_word(w, (tag, len(w)))
    auto.make_automaton()
    return auto


def _lowered(text: str) -> str:
    """Lower case, position by position."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(str.maketrans(UPPER, UPPER.lower()))


def _left(text: str, at: int, least: int, letters: str) -> int:
    """Start of the run of ``letters`` that ends at ``at``, not before ``least``."""
    size = 64
    while True:
        a = max(least, at - size)
        rest = len(text[a:at].rstrip(letters))
        if rest or a == least:
            return a + rest
        size *= 4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _iban_ok(run: str) -> bool:
    s = run.replace(" ", "").upper()
    return s.isascii() and 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _octet(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) < 4 and int(p or "0") <= 255


def _only_digits(run: str) -> str:
    return "".join(c for c in run if c in _DIGITS)


def _ipv6(run: str) -> bool:
    try:
        ipaddress.IPv6Address(run)
    except ValueError:
        return False
    return run.count(":") >= 2 and len([p for p in run.split(":") if p]) >= 2


def _word_start(text: str, at: int) -> bool:
    return at == 0 or not text[at - 1].isalnum()


class _Scan:
    """The parsers of one text; ``used[kind]``: end of the last stretch a base pattern consumed."""

    def __init__(self, text: str):
        self.text, self.used = text, [0, 0, 0, 0]
        self.base, self.more = [], set()

    # base kinds

    def at(self, start: int, end: int) -> None:
        text = self.text
        s = _left(text, start, self.used[EMAIL], _LOCAL)
        m = _DOMAIN.match(text, end) if s < start else None
        if m:
            self.base.append((s, EMAIL, m.end()))
            self.used[EMAIL] = m.end()
        self.wide(start, end)

    def dotted(self, start: int, end: int) -> None:
        if end <= self.used[IP]:
            return
        s = _left(self.text, start, self.used[IP], _DIGITS)
        m = _CHAIN.match(self.text, s)
        self.used[IP] = m.end()
        for q in _QUAD.finditer(self.text, s, m.end()):
            if all(map(_octet, q.group().split("."))):
                self.base.append((q.start(), IP, q.end()))

    def digits(self, start: int, end: int) -> None:
        if start < self.used[CARD]:
            return
        m = _NUMBER.match(self.text, start)
        self.used[CARD] = m.end()
        if m.end() - start >= 14:
            d = _only_digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                self.base.append((start, CARD, m.end()))

    def plus(self, start: int, end: int) -> None:
        if m := _PLUS.match(self.text, start):
            if 10 <= len(_only_digits(m.group())) <= 15:
                self.base.append((start, PHONE, m.end()))

    # other spellings

    def wide(self, start: int, end: int) -> None:
        """Quoted and non-ASCII local parts, non-ASCII domains, address literals."""
        text = self.text
        window = text[max(0, start - 65):start]  # a valid local part has at most 64 characters
        if not window or (window.isascii() and window[-1] != '"' and text[end:end + 1] != "["
                          and text[end:end + 256].isascii()):
            return
        local = _QUOTED.search(window) or _WIDE_LOCAL.search(window)
        if not local or local.end() - local.start() > 64:
            return
        if (m := _LITERAL.match(text, end)) and (_ipv6(m.group(1)) or _QUAD.fullmatch(m.group(1))):
            stop = m.end()
        elif (m := _WIDE_DOMAIN.match(text, end)) and not text[m.end():m.end() + 1].isalnum():
            stop = m.end()
        else:
            return
        self.more.add((start - len(window) + local.start(), EMAIL, stop))

    def spelt(self, start: int, end: int) -> None:
        text = self.text
        stop = start - 1 if text[start - 1:start] == " " and text[start] in "[(" else start
        s = _left(text, stop, 0, _LOCAL)
        if 0 < stop - s <= 64 and (m := _SPELT_DOMAIN.match(text, end)):
            self.more.add((s, EMAIL, m.end(1)))

    def mailto(self, start: int, end: int) -> None:
        at = self.text.find("@", end, end + 65)
        if at > end and not self.text[end:at].strip(_LOCAL) and (m := _HOST.match(self.text, at + 1)):
            if self.text[m.end():m.end() + 1] != ".":
                self.more.add((end, EMAIL, m.end()))

    def _number(self, m, least: int, most: int, kind: int, check=None) -> None:
        if m and least <= len(d := _only_digits(m.group(1))) <= most and (check is None or check(d)):
            self.more.add((m.start(1), kind, m.end(1)))

    def tel(self, start: int, end: int) -> None:
        if _word_start(self.text, start):
            self._number(_TEL.match(self.text, end), 7, 15, PHONE)

    def phone(self, start: int, end: int) -> None:
        if _word_start(self.text, start):
            self._number(_PHONE_CUE.match(self.text, end), 7, 15, PHONE)

    def card(self, start: int, end: int) -> None:
        self._number(_CARD_CUE.match(self.text, end), 12, 19, CARD, luhn)

    def account(self, start: int, end: int) -> None:
        if _word_start(self.text, start):
            self._number(_ACCOUNT_CUE.match(self.text, end), 6, 17, CARD)

    def iban(self, start: int, end: int) -> None:
        m = _IBAN_CUE.match(self.text, end)
        run = m.group(1) if m else ""
        while len(run) > 15:  # words may follow: the longest valid prefix that ends at a blank or the end
            if _iban_ok(run):
                self.more.add((m.start(1), CARD, m.start(1) + len(run)))
                return
            run = run[:run.rfind(" ")] if " " in run else ""

    def ipv6(self, start: int, end: int) -> None:
        if _word_start(self.text, start) and (m := _IP_CUE.match(self.text, end)):
            run = m.group(1).rstrip(".:") if not m.group(1).endswith("::") else m.group(1)
            if _ipv6(run):
                self.more.add((m.start(1), IP, m.start(1) + len(run)))

    def host(self, start: int, end: int) -> None:
        if (m := _LITERAL.match(self.text, end - 1)) and _ipv6(m.group(1)):
            self.more.add((m.start(1), IP, m.end(1)))

    def colons(self, start: int, end: int) -> None:
        text = self.text
        s = _left(text, start, max(0, start - 46), _HEXES)
        part = text[end:end + 46]
        e = end + len(part) - len(part.lstrip(_HEXES))
        run = text[s:e].rstrip(".")
        e = s + len(run)
        if _word_start(text, s) and not text[e:e + 1].isalnum() and len(run) <= 45 and run.count(":") >= 3 and _ipv6(run):
            self.more.add((s, IP, e))


def scan(text: str, auto) -> tuple[list, list]:
    """(base spans, all spans), both sorted (start, kind number, end)."""
    s = _Scan(text)
    for last, (tag, size) in auto.iter(_lowered(text)):
        getattr(s, tag)(last + 1 - size, last + 1)
    s.base.sort()
    return s.base, sorted(s.more.union(s.base))


def _listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list) -> str:
    """``text`` with every maximal covered stretch replaced by the kind of its first span, as ``[EMAIL]``."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pii_scan(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus n_email, n_ip, n_card, n_phone (base spans), base, spans and redacted."""

    def make():
        auto = anchors()

        def f(texts):
            cols = [[] for _ in range(7)]
            for t in texts:
                base, spans = scan(t or "", auto)
                kinds = [k for _, k, _ in base]
                for c, v in zip(cols, (*(kinds.count(k) for k in range(4)), _listed(base), _listed(spans),
                                       redact(t, spans) if spans else t)):
                    c.append(v)
            return cols
        return f

    names = [*((f"n_{k}", "long") for k in KINDS), ("base", "string"), ("spans", "string"), ("redacted", "string")]
    names = [(prefix + n, t) for n, t in names]
    return add_columns(docs.drop(*(n for n, _ in names)), make, names, text)


def op12(docs: DataFrame) -> DataFrame:
    r = pii_scan(docs.select("doc_id", "text"))
    return r.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
