"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, URL schemes,
identifier cues, dots between digits and neighbouring digits. A local parser for each kind
then walks from the anchor to the boundaries and validates what it finds, so no pattern is
tried at every position of the text.

Base kinds (fixed rules, leftmost, non-overlapping for each kind; a candidate that
fails its validation is dropped without a retry): email, ip, card, phone.
Added kinds: ``contact`` (a telephone number in a usual layout that the base rule lost
because more digits follow it), ``account`` (after a cue, an IBAN with valid check digits
or a US social security number; a card number that the base rule lost beside other
digits), ``secret`` (the value after a credential cue, if it looks random, keys with a
known prefix and private key blocks) and ``url`` (URLs that carry a user and password). Offsets count code points, the end is exclusive.

Defined cases: a null text is the empty text; very long texts are read whole, and all walks
are linear in the text's length, also for long runs of digits or letters; between equal
matches the leftmost counts, so no ties arise; repeated rows give repeated results; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import map_rows

BASE = ("email", "ip", "card", "phone")
ADDED = ("contact", "account", "secret", "url")

# Cues of credentials and accounts, in lower case.
SECRET_CUES = ("password", "passwd", "pwd", "api_key", "apikey", "api-key", "secret", "token", "access_key", "auth_key", "private_key")
ACCOUNT_CUES = ("iban", "ssn", "social security")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk-", "xoxb-", "xoxp-", "AIza", "-----BEGIN ")
SCHEMES = ("http://", "https://", "ftp://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_VALUE = re.compile(r"[\"']?\s{0,3}(?:[:=]|is)\s{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,})")
_IBAN = re.compile(r"[\s:#=]{1,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])")
_SSN = re.compile(r"[\s:#=]{1,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
# Characters of an account number, by country.
_IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 "
        "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
        "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
# Layouts of keys, by prefix.
_KEY = re.compile(
    r"(?:A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pos]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|sk-[A-Za-z0-9_-]{20,}|xox[bp]-[A-Za-z0-9-]{10,}"
    r"|AIza[A-Za-z0-9_-]{35}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?)"
)
_USUAL_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_CREDENTIAL = re.compile(r"[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+@[^\s\"'<>]+")


@lru_cache(maxsize=1)
def anchors():
    """The automaton; a cue is found as written, capitalised or in capitals."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, cues in (("email", ("@",)), ("phone", ("+",)), ("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("url", SCHEMES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, (kind, 0))
    for prefix in KEY_PREFIXES:
        found.add_word(prefix, ("key", len(prefix)))
    for a in "0123456789":
        for b in "0123456789":
            found.add_word(f"{a}.{b}", ("ip", 3))
            for between in ("", " ", "-"):
                found.add_word(f"{a}{between}{b}", ("card", 2 + len(between)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_valid(account: str) -> bool:
    plain = account.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """An account number after a cue; what follows it after a blank may look like a part of it.

    The country's length comes first, then the whole match; a country that is not known
    has each shorter end between groups tried.
    """
    m = _IBAN.match(text, at)
    if not m:
        return None
    start, whole = m.start(1), m[1]
    ends = [g.end() for g in re.finditer("[A-Z0-9]+", whole)][::-1]
    if length := _IBAN_LENGTHS.get(whole[:2]):
        filled = [i + 1 for i, c in enumerate(whole) if c != " "]
        ends = [e for e in filled[length - 1 : length] if e in ends] + ends[:1]
    return next(((start, start + e) for e in ends if iban_valid(whole[:e])), None)


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _addresses(text: str, at: int, after: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses in the run of digits and dots round an anchor, and the end of the run."""
    start = at
    while start > after and "0" <= text[start - 1] <= "9":
        start -= 1
    run = _DOTTED.match(text, start)
    found, parts = [], run[0].split(".")
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        end = start + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            found.append((start, end))
        start = end + 1
    return found, run.end()


def _cards(text: str, at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """The run of digits that an anchor begins, if it is a card number, card numbers within a longer run, and its end."""
    run = _CARD.match(text, at)
    digits = run[0].replace(" ", "").replace("-", "")
    if 13 <= len(digits) <= 19 and luhn(digits):
        return [run.span()], [], run.end()
    within: list[tuple[int, int]] = []
    if len(digits) > 16:
        groups, i = list(re.finditer("[0-9]+", run[0])), 0
        while i < len(groups):
            for n in (1, 4, 3):  # one group, 4-4-4-4 or 4-6-5
                part = [g[0] for g in groups[i : i + n]]
                shape = tuple(map(len, part))
                if (n == 1 and 13 <= shape[0] <= 19 or shape in ((4, 4, 4, 4), (4, 6, 5))) and luhn("".join(part)):
                    within.append((run.start() + groups[i].start(), run.start() + groups[i + n - 1].end()))
                    i += n - 1
                    break
            i += 1
    return [], within, run.end()


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, by start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    if not text:
        return spans
    ends, inside = dict.fromkeys(spans, 0), []
    for last, (kind, length) in anchors().iter(text):
        span = None
        if kind == "card" or kind == "ip":
            first = last + 1 - length
            if first < ends[kind]:  # of a run that was parsed from its first anchor
                continue
            if kind == "card":
                whole, within, ends[kind] = _cards(text, first)
                spans["card"] += whole
                inside += within
            else:
                whole, ends[kind] = _addresses(text, first, ends[kind])
                spans["ip"] += whole
            continue
        if kind == "key":
            kind, first = "secret", last + 1 - length
            before = text[first - 1 : first] if first else " "
            m = _KEY.match(text, first) if first >= ends[kind] and not before.isalnum() else None
            span = m.span() if m else None
            if span:
                spans[kind].append(span)
                ends[kind] = span[1]
            continue
        if kind == "email":
            span = _email(text, last, ends[kind])
        elif last < ends[kind]:
            continue
        elif kind == "phone":
            if m := _PHONE.match(text, last):
                ends[kind] = m.end()  # a match that fails is not tried again from within
                span = m.span() if 9 <= sum(map(str.isdigit, m[0])) <= 15 else None
                if span is None and (usual := _USUAL_PHONE.match(text, last)):
                    spans["contact"].append(usual.span())
        elif kind == "secret":
            m = _VALUE.match(text, last + 1)
            span = m.span(1) if m and any(c in "0123456789" for c in m[1]) and any(c.isalpha() for c in m[1]) else None
        elif kind == "account":
            if m := _SSN.match(text, last + 1):
                span = m.span(1)
            else:
                span = _iban(text, last + 1)
        elif m := _CREDENTIAL.match(text, last + 1):
            span = m.span()
        if span:
            spans[kind].append(span)
            ends[kind] = span[1]
    spans["account"] = sorted(spans["account"] + inside)
    return spans


def redact(text: str | None, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    if not text or not any(spans.values()):
        return text
    out, done = [], 0
    for start, end, kind in sorted(((s, e, k) for k, v in spans.items() for s, e in v), key=lambda x: (x[0], -x[1])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, found array<struct<kind, start, end>>)`` by kind, then start."""
    kind = dict(df.dtypes)[id_col]

    def row(key, text):
        return key, [{"kind": k, "start": s, "end": e} for k, v in find(text).items() for s, e in v]

    return map_rows(df.select(id_col, text_col), row, f"`{id_col}` {kind}, found array<struct<kind: string, start: long, end: long>>")


def redact_column(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its texts redacted; all columns and rows stay."""
    at = df.columns.index(text_col)

    def row(*values):
        text = values[at]
        return (*values[:at], redact(text, find(text)), *values[at + 1 :])

    return map_rows(df, row, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]))
