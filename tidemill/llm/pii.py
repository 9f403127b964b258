"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are found by fixed patterns and checks and always stay: nearby words change
their score, never their fate. Further kinds (iban, ssn, birth) are added if their checks hold and their score, raised
or lowered by words within CONTEXT characters, reaches LEAST.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import chunks

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "birth")
CONTEXT = 48
LEAST = 0.5

# fixed values: the patterns of the base kinds. Addresses are searched for from their @ on, and four
# numbers only from the start of a run of digits, so that long runs cost no more than their length.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# fixed values: lengths of IBANs by country
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Where an IBAN may start; its country's length says where it ends.
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2})[0-9]{2}(?=[\x20-]?[A-Za-z0-9])")
_IBAN_SIGN = re.compile(r"[\x20-]?[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_BIRTH = re.compile(r"(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9])")
#: For each kind: its score without context, words that raise it and words that lower it.
CONTEXT_WORDS = {
    "email": (0.9, r"e-?mail|contact|kontakt|contacto|courriel", r"example|noreply"),
    "ip": (0.6, r"ip|address|adresse|host|server|client", r"version|release|v"),
    "card": (0.7, r"card|visa|mastercard|amex|credit|karte|tarjeta|carte", r"order|tracking|isbn|serial"),
    "phone": (0.7, r"phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone", r"order|serial"),
    "iban": (0.8, r"iban|account|bank|konto|cuenta|compte", r"serial|order"),
    "ssn": (0.3, r"ssn|social security|tax id", r"order|serial|part|isbn"),
    "birth": (0.1, r"born|birth|dob|geboren|geburtsdatum|nacid[oa]|nacimiento|né|née|naissance", r"published|updated|released"),
}
_CONTEXT = {k: (base, re.compile(rf"\b(?:{up})\b", re.I), re.compile(rf"\b(?:{down})\b", re.I)) for k, (base, up, down) in CONTEXT_WORDS.items()}
#: A text without any of these holds no span of any kind.
_ANY = re.compile(r"[0-9@]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_LONG_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        if m := _DOMAIN.match(text, at + 1):
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _small(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text, by kind and start: leftmost, not overlapping within a kind, failing ones dropped."""
    if not _ANY.search(text):
        return []
    out = []
    out += [("email", *x) for x in _emails(text)]
    if _DOTTED.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    if _LONG_NUMBER.search(text):
        out += [("card", *m.span()) for m in _CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _ssn_ok(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that start like an IBAN, as long as its country's are, in groups or not, with the right check digits."""
    end = 0
    for m in _IBAN.finditer(text):
        left = IBAN_LENGTHS.get(m[1].upper(), 0) - 4
        if m.start() < end or left <= 0:
            continue
        at = m.end()
        while left and (sign := _IBAN_SIGN.match(text, at)):
            at, left = sign.end(), left - 1
        if not left and not (at < len(text) and text[at].isalnum()) and mod97(re.sub(r"[\x20-]", "", text[m.start() : at]).upper()):
            end = at
            yield m.start(), at


def _birth_ok(text: str) -> bool:
    """Whether a date of the calendar from 1900 on can be meant: year first, or last after day and month in either order."""
    part = [int(x) for x in re.split(r"[-./]", text)]
    year, a, b = part if part[0] > 31 else (part[2], part[1], part[0])
    for month, day in ((a, b),) if part[0] > 31 else ((a, b), (b, a)):
        try:
            return date(year, month, day).year >= 1900
        except ValueError:
            continue
    return False


def score(text: str, kind: str, start: int, end: int) -> float:
    """0 to 1: the kind's score, plus 0.4 near a word that supports it, less 0.3 near one that speaks against it."""
    base, up, down = _CONTEXT[kind]
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    return min(1.0, max(0.0, base + 0.4 * bool(up.search(near)) - 0.3 * bool(down.search(near))))


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, base kinds first: (kind, start, end) in code points, by kind and start."""
    base = base_spans(text)
    out = list(base)
    if _ANY.search(text):
        taken = sorted((s, e) for _, s, e in base)
        starts = [s for s, _ in taken]

        def free(start: int, end: int) -> bool:
            at = bisect.bisect_left(starts, end)
            return not any(e > start for _, e in taken[max(0, at - len(BASE)) : at])  # of each kind at most one reaches over it

        for kind, found in (("iban", _ibans(text)), ("ssn", (m.span() for m in _SSN.finditer(text) if _ssn_ok(m[0]))), ("birth", (m.span() for m in _BIRTH.finditer(text) if _birth_ok(m[0])))):
            out += [(kind, *x) for x in found if free(*x) and score(text, kind, *x) >= LEAST]
    return out


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced together."""
    merged: list[list] = []
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base spans as
    kind:start:end, comma-joined), spans (all spans, joined likewise) and scores (of all spans, in that order).

    Null texts are taken as empty and have no span. Rows are judged one by one, so repeated ids and null
    ids are no matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            rows = []
            for text in b.column("text").to_pylist():
                text = text or ""
                own = spans(text)
                base = [x for x in own if x[0] in BASE]
                kinds = [x[0] for x in base]
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(own), [score(text, *x) for x in own]))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.list_(pa.float64()))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores array<double>").withColumnRenamed("id", id_col)


def scrub(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of `docs` with all spans of the text replaced by their kind; length_col, if there is such
    a column, follows the new text. Null texts stay null."""
    lengths = length_col in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text_col):
            texts = b.column(text_col).to_pylist()
            changed = {i: redact(t, own) for i, t in enumerate(texts) if t and (own := spans(t))}
            if changed:
                at = b.schema.get_field_index(text_col)
                b = b.set_column(at, b.schema.field(at), pa.array([changed.get(i, t) for i, t in enumerate(texts)], b.schema.field(at).type))
                if lengths:
                    at = b.schema.get_field_index(length_col)
                    b = b.set_column(at, b.schema.field(at), pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(b.column(length_col).to_pylist())], b.schema.field(at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
