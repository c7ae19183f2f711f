"""Operator 13, personal data by anchor expansion.

One Aho-Corasick automaton walks a text once and reports anchors: at-signs, a plus or a dot before a
digit, digits, ``://`` and identifier cues (``password``, ``token``, ``iban`` and so on). Each anchor is
handed to a small local parser that looks left and right of it, finds the exact boundaries and checks the
value. Parsers keep the end of what they have read, so every text is read a bounded number of times,
whatever it holds.

Base kinds (``base`` true): what these expressions match, leftmost and without overlaps inside a kind; a
match that fails its check is passed over and not tried again:
* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``;
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts up to 255;
* card ``[0-9]([\\x20-]?[0-9])+`` with 16 to 19 digits that pass Luhn;
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 8 to 15 digits.

Added (``base`` false), because the expressions above swallow neighbours or don't know the shape:
* card: whole digit groups of 16 to 19 digits passing Luhn inside a longer chain of digits;
* phone: the shortest run of whole digit groups with 10 to 15 digits at the head of a match that was too long;
* address: a web address that names a person (user information before the host, a ``~name`` or
  ``@name`` segment, or a segment after ``user``, ``users``, ``u``, ``profile`` or ``people``);
* account: the value after an identifier cue and ``=`` or ``:``, 6 characters or more with a digit;
  after ``iban`` the check digits must be right.

Offsets count code points, the end is exclusive. Defined results: null text is empty and has no span;
repeated rows and null ids are read each by itself; extra columns don't matter (only the id and the
text are read); an empty table gives no rows. Spans are ordered by kind as listed, then by start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "address", "account")
CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "account", "acct", "iban", "ssn", "passport", "user_id", "userid", "username", "login")
PEOPLE = ("user", "users", "u", "profile", "people")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_PARTS = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]++")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_REST = re.compile(r"[^\s\"'<>\\^`{|}]++")
_VALUE = re.compile(r"[ ]{0,4}+[=:][ ]{0,4}+[\"']?+([A-Za-z0-9_+/.-]{6,128}+)")
_IBAN = re.compile(r"[ ]{0,4}+[=:]?+[ ]{0,4}+([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}+)")
_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word("." + d, ("dot", 2))
        found.add_word("+" + d, ("plus", 2))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _iban(value: str) -> int:
    """Length of the longest run of whole groups whose check digits are right; 0 if none are."""
    for end in [len(value), *[k for k in range(len(value) - 1, 14, -1) if value[k] == " "]]:
        code = value[:end].replace(" ", "").upper()
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
    return 0


def _long_chain(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Whole digit groups, one or more in a row, that make a card number inside a chain of digits; leftmost, longest first."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    k = 0
    while k < len(groups):
        digits, last = 0, None
        for j in range(k, len(groups)):
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits >= 16 and luhn("".join(text[a:b] for a, b in groups[k : j + 1])):
                last = j
        if last is None:
            k += 1
        else:
            yield groups[k][0], groups[last][1]
            k = last + 1


def _long_phone(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The head of a phone match that ran into the numbers behind it."""
    digits = 0
    for m in _GROUP.finditer(text, start + 1, end):
        digits += m.end() - m.start()
        if digits >= 10:
            return (start, m.end()) if digits <= 15 else None
    return None


def _names_person(url: str) -> bool:
    authority, _, path = url.partition("/")
    if "@" in authority[1:]:
        return True
    parts = path.split("?")[0].split("/")
    return any(len(p) > 1 and p[0] in "~@" for p in parts) or any(a.lower() in PEOPLE and b for a, b in zip(parts, parts[1:]))


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of every span of a text."""
    found = []
    email_end = ip_end = card_end = url_end = account_end = 0
    lowered = text.encode().lower().decode()  # A-Z only: places stay the same
    for last, (anchor, length) in _automaton().iter(lowered):
        at = last - length + 1
        if anchor == "digit":
            if at < card_end:
                continue
            m = _CHAIN.match(text, at)
            card_end = m.end() if m else at + 1
            if not m or card_end - at < 16:
                continue
            digits = "".join(_GROUP.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", at, card_end, True))
            elif len(digits) > 16:
                found += [("card", a, b, False) for a, b in _long_chain(text, at, card_end)]
        elif anchor == "dot":
            if at < ip_end or not at or text[at - 1] not in _DIGITS:
                continue
            a = at
            while a > ip_end and text[a - 1] in _DIGITS:
                a -= 1
            m = _PARTS.match(text, a)
            ip_end = m.end()
            parts = m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[k : k + 4]):
                    found.append(("ip", a, a + size, True))
                a += size + 1
        elif anchor == "at":
            a = at
            while a > email_end and text[a - 1] in _LOCAL:
                a -= 1
            if a < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append(("email", a, email_end, True))
        elif anchor == "plus":
            if m := _PHONE.match(text, at):
                digits = sum(map(len, _GROUP.findall(m[0])))
                if 8 <= digits <= 15:
                    found.append(("phone", at, m.end(), True))
                elif digits > 15 and (span := _long_phone(text, at, m.end())):
                    found.append(("phone", *span, False))
        elif anchor == "scheme":
            a = at
            while a > url_end and lowered[a - 1] in _SCHEME:
                a -= 1
            if a < at and lowered[a].isalpha() and (m := _REST.match(text, at + 3)):
                rest = m[0].rstrip(".,;:!?)]")
                url_end = max(at + 3, at + 3 + len(rest))
                if _names_person(rest):
                    found.append(("address", a, url_end, False))
        elif at >= account_end and not (at and lowered[at - 1].isalnum()):
            kind = _IBAN if lowered.startswith("iban", at) else _VALUE
            m = kind.match(text, last + 1)
            size = 0 if not m else _iban(m[1]) if kind is _IBAN else len(m[1]) * any(c in _DIGITS for c in m[1])
            if size:
                account_end = m.start(1) + size
                found.append(("account", m.start(1), account_end, False))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (kind, start, end, base) of each document; row-local, no shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base"), s)) for s in find(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans {_SPANS}")
    return found.select(F.col("id").alias(id_col), "spans")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
