import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import pii


def brute(text):
    """The base spans by the plain patterns."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in digits(m[0])]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1+@.- ()05é9_%4", max_size=80))
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_on_documents(spark, medium):
    rng = random.Random(1)
    for r in spark.read.parquet(f"{medium}/documents.parquet").collect():
        text = r.text
        if rng.random() < 0.3:
            text += " 4111 1111 1111 1111, 4111-1111-1111-1112; a@b.co,c@d @e.f x@y +44 (0)20 7946 0958 1.2.3.4.5.6.7.8 256.1.1.1"
        assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 ok", ["iban"]),
        ("IBAN DE89 3704 0044 0532 0130 01 bad", []),
        ("SSN: 123-45-6789", ["ssn"]),
        ("part 123-45-6789", []),
        ("SSN: 000-45-6789", []),
        ("born 1980-02-28, born 12.5.1980", ["birth", "birth"]),
        ("born 1980-02-30", []),
        ("updated 1980-02-03", []),
        ("card 4111 1111 1111 1111", ["card"]),
        ("born 12/31/1990", ["birth"]),
        ("born 31/12/1990 or 31-12-1990, 1990/12/31", ["birth"] * 3),
        ("born 13/31/1990", []),
        ("born 12.31-1990", []),
        ("DOB 2026-01-02", ["birth"]),
        ("DOB 1899-01-02", []),
        ("IBAN ES91 2100 0418 4502 0005 1332 AND more", ["iban"]),
        ("iban de89370400440532013000", ["iban"]),
        ("IBAN: NO9386011117947.", ["iban"]),
        ("IBAN MT84MALT011000012345MTLCAST001S and FR14 2004 1010 0505 0001 3M02 606", ["iban", "iban"]),
        ("account DE89370400440532013000X", []),
        ("XX89370400440532013000 and DE8937040044053201300", []),
        ("no data", []),
    ],
)
def test_more_kinds(text, kinds):
    assert [k for k, _, _ in pii.spans(text)] == kinds


def brute_more(text):
    """The added spans, every stretch of the text tried by itself."""
    out = []
    base = [x[1:] for x in brute(text)]
    free = lambda a, b: not any(s < b and a < e for s, e in base)
    near = lambda kind, a, b: (lambda n, c: c[0] + 0.4 * bool(re.search(rf"\b(?:{c[1]})\b", n, re.I)) - 0.3 * bool(re.search(rf"\b(?:{c[2]})\b", n, re.I)))(text[max(0, a - pii.CONTEXT) : a] + " " + text[b : b + pii.CONTEXT], pii.CONTEXT_WORDS[kind])
    ascii_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    end = 0
    for a in range(len(text)):
        size = pii.IBAN_LENGTHS.get(text[a : a + 2].upper())
        if a < end or not size or (a and text[a - 1] in ascii_):
            continue
        for b in range(a + size, min(len(text), a + 2 * size) + 1):
            own = text[a:b]
            plain = own.replace(" ", "").replace("-", "").upper()
            if len(plain) == size and own[-1] in ascii_ and all(c in ascii_ for c in plain) and not re.search("[ -][ -]", own) and own[2:4].isdigit() and not (b < len(text) and text[b].isalnum()):
                if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                    end = b
                    if free(a, b) and near("iban", a, b) >= pii.LEAST:
                        out.append(("iban", a, b))
                    break
    for a in range(len(text)):
        own = text[a : a + 11]
        if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", own) and not (a and text[a - 1] in "0123456789-") and not (a + 11 < len(text) and text[a + 11] in "0123456789-"):
            if own[:3] not in ("000", "666") and own[0] != "9" and own[4:6] != "00" and own[7:] != "0000" and free(a, a + 11) and near("ssn", a, a + 11) >= pii.LEAST:
                out.append(("ssn", a, a + 11))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["IBAN ", "DE89 3704 0044 0532 0130 00", "de89370400440532013000", "NO93 8601 1117 947", " ", "-", "x", "AND", "SSN ", "123-45-6789", "000-12-3456", "9", "order ", "a@b.co", "+44 20 7946 0958", "é"]), max_size=8))
def test_added_kinds_equal_brute_force(parts):
    text = "".join(parts)
    assert [x for x in pii.spans(text) if x[0] in ("iban", "ssn")] == brute_more(text)


def test_redact():
    text = "write to a.b@c.org or +1 555 123 4567, SSN 123-45-6789."
    assert pii.redact(text, pii.spans(text)) == "write to [EMAIL] or [PHONE], SSN [SSN]."
    assert pii.redact("abcdef", [("x", 0, 3), ("y", 2, 5)]) == "[X]f"


def test_rows(spark):
    rows = [(1, "mail é a@b.org", 99), (1, "mail é a@b.org", 99), (None, None, None), (2, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    out = pii.find(df).collect()
    one = [r for r in out if r.doc_id == 1]
    assert len(out) == 4 and [r.n_email for r in one] == [1, 1] and one[0].spans == "email:7:14"
    assert one[0].base_sha256 == hashlib.sha256(b"email:7:14").hexdigest()
    assert {r.base_sha256 for r in out if r.doc_id != 1} == {hashlib.sha256(b"").hexdigest()}
    clean = pii.scrub(df)
    assert clean.schema == df.schema
    assert sorted(tuple(r) for r in clean.where("doc_id IS NOT NULL").collect()) == [(1, "mail é [EMAIL]", 14), (1, "mail é [EMAIL]", 14), (2, "", 0)]
    assert clean.where("doc_id IS NULL").first().text is None
    assert pii.find(df.limit(0)).count() == 0 and pii.scrub(df.limit(0)).count() == 0
    other = df.select("doc_id", "text").withColumnRenamed("doc_id", "spans")
    assert pii.scrub(other).columns == ["spans", "text"] and pii.find(other, id_col="spans").count() == 4


def test_long_runs_take_linear_time():
    pii.spans("a" * 1_000_000 + " " + "1" * 1_000_000 + " x@y.z " + "1." * 200_000 + "+" * 100_000 + "@" * 100_000)
