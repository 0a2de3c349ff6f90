"""Personal data: one Aho-Corasick pass finds anchors (at-signs, schemes, plus signs, digits, identifier cues); local
parsers then expand each anchor to its boundaries and validate it.

Base kinds, leftmost and non-overlapping inside a kind:
  email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
  ip     four dotted numbers, each at most 255
  card   12 to 19 digits with single blanks or hyphens between them, passing the Luhn check
  phone  ``+``, a digit, and blanks, brackets, dots, hyphens and digits up to the last digit; 9 to 15 digits
Added kinds: ``iban`` (mod-97 check), ``ssn`` and ``account`` (numbers after a cue), ``login`` (user:password after a
scheme), ``mailat`` (an address spelt with (at) and (dot)). Added spans never change base ones and may overlap them.

Null and empty texts have no spans. Offsets are code points, end exclusive. Every text is read whole, in one pass.
"""

import hashlib

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from prefmill.llm.base import map_steps

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "account", "login", "mailat")
RANK = {kind: i for i, kind in enumerate(KINDS)}

DIGITS = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
WORD = frozenset("abcdefghijklmnopqrstuvwxyz") | UPPER | DIGITS
LOCAL = WORD | frozenset("._%+-")
LABEL = WORD | frozenset("-")
DIALED = DIGITS | frozenset(" ().-")

#: Cue words before identity and account numbers, and spelt-out at-signs and dots.
SSN_CUES = ("SSN", "ssn", "Social Security", "social security")
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "Konto", "konto", "cuenta", "Cuenta", "compte", "Compte")
AT = ("(at)", "[at]", "{at}")
DOT = ("(dot)", "[dot]", "{dot}")
CUE_FILLERS = frozenset(" .:#-") | frozenset("numberoNuméroNrnº")
CUE_REACH = 24
IBAN_LENGTHS = range(15, 35)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, tag in [("@", "@"), ("+", "+"), ("://", "scheme"), *((d, "digit") for d in sorted(DIGITS)),
                      *((c, "ssn") for c in SSN_CUES), *((c, "account") for c in ACCOUNT_CUES), *((c, "at") for c in AT)]:
        found.add_word(word, tag)
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, floor: int, allowed: frozenset) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = _back(text, at, floor, LOCAL)
    if start == at:
        return None
    end = _run(text, at + 1, LABEL)
    if end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (to := _run(text, end + 1, LABEL)) > end + 1:
        labels, end = labels + 1, to
    return (start, end) if labels else None


def _quad(text: str, at: int) -> tuple[int, bool, bool]:
    """End of up to four dotted numbers from ``at``; whether there are four; whether all are at most 255."""
    end = _run(text, at, DIGITS)
    parts = [text[at:end]]
    while len(parts) < 4 and end < len(text) and text[end] == "." and (to := _run(text, end + 1, DIGITS)) > end + 1:
        parts.append(text[end + 1:to])
        end = to
    return end, len(parts) == 4, all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def _chain(text: str, at: int) -> tuple[int, str]:
    """End and digits of the longest run of digits with single blanks or hyphens between them."""
    digits, n = [text[at]], len(text)
    end = at + 1
    while end < n:
        if text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return end, "".join(digits)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _phone(text: str, at: int) -> tuple[int, int] | None:
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, DIALED)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > at + 3 else None


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """``at`` is the first check digit."""
    if at < 2 or text[at - 1] not in UPPER or text[at - 2] not in UPPER or at > 2 and text[at - 3] in WORD:
        return None
    end, kept = at, [text[at - 2:at]]
    while end < len(text) and sum(map(len, kept)) < IBAN_LENGTHS[-1]:
        if text[end] in DIGITS or text[end] in UPPER:
            kept.append(text[end])
            end += 1
        elif text[end] == " " and end + 1 < len(text) and (text[end + 1] in DIGITS or text[end + 1] in UPPER):
            end += 1
        else:
            break
    code = "".join(kept)
    if len(code) not in IBAN_LENGTHS or not code[2:4].isdigit() or end < len(text) and text[end] in WORD:
        return None
    value = "".join(c if c in DIGITS else str(ord(c) - 55) for c in code[4:] + code[:4])
    return (at - 2, end) if int(value) % 97 == 1 else None


def _cued(text: str, at: int) -> int | None:
    """Position of the first digit after a cue that ends at ``at``, when only filler stands between."""
    stop = min(len(text), at + CUE_REACH)
    while at < stop and text[at] in CUE_FILLERS:
        at += 1
    return at if at < stop and text[at] in DIGITS else None


def _ssn(text: str, at: int) -> tuple[int, int] | None:
    end = at + 11
    part = text[at:end]
    ok = len(part) == 11 and part[3] == part[6] == "-" and all(c in DIGITS for c in part.replace("-", "", 2))
    return (at, end) if ok and part[:3] not in ("000", "666") and (end == len(text) or text[end] not in WORD) else None


def _login(text: str, at: int) -> tuple[int, int] | None:
    """user:password after ``://`` that ends at ``at``, up to the at-sign."""
    end, colon = at, 0
    while end < len(text) and text[end] > " " and text[end] not in "/?#@<>\"'":
        colon += text[end] == ":"
        end += 1
    return (at, end) if colon and end < len(text) and text[end] == "@" and end > at + 2 else None


def _spelt(text: str, start: int, end: int) -> tuple[int, int] | None:
    """An address around a spelt at-sign that takes text[start:end]."""
    right = start - 1 if start and text[start - 1] == " " else start
    left = _back(text, right, 0, LOCAL)
    at = end + (end < len(text) and text[end] == " ")
    stop = _run(text, at, LABEL)
    if left == right or stop == at:
        return None
    labels = 0
    while True:
        to = stop + (stop < len(text) and text[stop] == " ")
        mark = next((d for d in (*DOT, ".") if text.startswith(d, to)), None)
        if mark is None or mark == "." and to != stop:
            break
        to += len(mark)
        to += mark != "." and to < len(text) and text[to] == " "
        if (nxt := _run(text, to, LABEL)) == to:
            break
        labels, stop = labels + 1, nxt
    return (left, stop) if labels else None


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span, by start, then kind."""
    out = []
    done = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin

    def add(kind: str, span, valid: bool = True):
        if span:
            done[kind] = span[1]
            if valid:
                out.append((span[0], kind, span[1]))

    for last, tag in anchors.iter(text):
        if tag == "digit":
            if last >= done["card"]:
                done["card"], digits = _chain(text, last)
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((last, "card", done["card"]))
            if last >= done["ip"]:
                end, four, valid = _quad(text, last)
                done["ip"] = end
                if four and valid:
                    out.append((last, "ip", end))
            if last >= done["iban"] and last >= 2 and text[last - 1] in UPPER:
                add("iban", _iban(text, last))
        elif tag == "@":
            if last >= done["email"]:
                add("email", _email(text, last, done["email"]))
        elif tag == "+":
            if last >= done["phone"] and (span := _phone(text, last)):
                add("phone", span, 9 <= sum(c in DIGITS for c in text[span[0]:span[1]]) <= 15)
        elif tag == "scheme":
            add("login", _login(text, last + 1))
        elif tag == "at":
            if last >= done["mailat"]:
                add("mailat", _spelt(text, last - 3, last + 1))
        elif (at := _cued(text, last + 1)) is not None and at >= done[tag]:
            if tag == "ssn":
                add("ssn", _ssn(text, at))
            else:
                end, digits = _chain(text, at)
                add("account", (at, end), 6 <= len(digits) <= 19)
    return sorted(out, key=lambda s: (s[0], RANK[s[1]]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def masked(text: str, spans) -> str:
    """Spans become [KIND]; of overlapping spans the union is replaced, named after the first."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per document."""
    anchors = automaton()

    def step(batch):
        found = [spans_of(t or "", anchors) for t in batch.column("text").to_pylist()]
        base = [[s for s in f if s[1] in BASE] for f in found]
        counts = [[sum(s[1] == kind for s in f) for f in base] for kind in BASE]
        return [batch.column(key), *counts, [hashlib.sha256(joined(f).encode()).hexdigest() for f in base],
                [joined(f) for f in found]]

    kind = docs.schema[key].dataType.simpleString()
    return map_steps(docs.select(key, "text"), f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, "
                     "base_sha256 string, spans string", step)


def redact(docs: DataFrame) -> DataFrame:
    """The same columns with every span masked in ``text``; ``n_chars`` follows. A null text stays null."""
    anchors = automaton()

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: None if t is None else masked(t, spans_of(t, anchors)))

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
