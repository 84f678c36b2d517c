"""Pseudonyms against a pseudonymiser in plain Python, decryption with the key, and texts that are hard on patterns."""

import hashlib
import random
import re

import pytest

from popmeasure.llm import pseudonyms

KEY = pseudonyms.KEY


def luhn(n):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(n))) % 10 == 0


def digest(kind, turn, value):
    return hashlib.sha256(f"{KEY}|{kind}|{turn}|{value}".encode()).hexdigest()


def shifted(part, d, sign=1):
    out = ""
    for i, c in enumerate(part):
        by = sign * int(d[i % 32 * 2 : i % 32 * 2 + 2], 16)
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            if ord(first) <= ord(c) < ord(first) + size:
                c = chr((ord(c) - ord(first) + by) % size + ord(first))
                break
        out += c
    return out


def permuted_text(text, kind, back=False):
    shape = re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", text)))
    sides = [text[: len(text) // 2], text[len(text) // 2 :]]
    for i in reversed(range(pseudonyms.ROUNDS)) if back else range(pseudonyms.ROUNDS):
        sides[i % 2] = shifted(sides[i % 2], digest(kind, i, f"{shape}|{sides[1 - i % 2]}"), -1 if back else 1)
    return "".join(sides)


def permuted(value, parts, kind):
    sides = list(divmod(value, parts[1]))
    for i in range(pseudonyms.ROUNDS):
        sides[i % 2] = (sides[i % 2] + int(digest(kind, i, sides[1 - i % 2])[:15], 16)) % parts[i % 2]
    return sides[0] * parts[1] + sides[1]


def card(found):
    digits = re.sub("[^0-9]", "", found)
    body = permuted_text(digits[:-1], "card")
    new = iter(next(body + str(d) for d in range(10) if luhn(body + str(d))))
    return "".join(next(new) if c.isdigit() else c for c in found)


def with_cards(text):
    """By definition: at each start of a group of digits the longest run of whole groups that is a card, from left to right."""
    out, k = "", 0
    while k < len(text):
        if text[k].isdigit() and not (k and text[k - 1].isdigit()):
            for size in range(19, 12, -1):
                m = re.match(r"\d(?:[ -]?\d){%d}(?!\d)" % (size - 1), text[k:])
                if m and luhn(re.sub("[^0-9]", "", m[0])):
                    out, k = out + card(m[0]), k + m.end()
                    break
            else:
                out, k = out + text[k], k + 1
        else:
            out, k = out + text[k], k + 1
    return out


def ssn(found):
    area, group, serial = map(int, found.split("-"))
    v = permuted(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, (898 * 99, 9999), "ssn")
    area = v // (99 * 9999) + 1
    return f"{area + (area >= 666):03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"


def ip(found):
    v = permuted(sum(int(p) << s for p, s in zip(found.split("."), (24, 16, 8, 0), strict=True)), (65536, 65536), "ip")
    return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))


def brute(text):
    out, last = "", 0
    for m in re.finditer(f"({pseudonyms.IP})|({pseudonyms.SSN})", text, re.ASCII):
        out += with_cards(text[last : m.start()]) + (ip(m[0]) if m[1] else ssn(m[0]))
        last = m.end()
    return out + with_cards(text[last:])


def replaced(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pseudonyms.pseudonymised(rows).orderBy("doc_id").collect()]


def test_numbers_side_by_side_against_plain_python(spark):
    rng = random.Random(6)
    cards = ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "340000000000009", "6011 0000 0000 0004 123", "30000000000004"]
    parts = [*cards, "12/27", "555", "7", "1234", "192.168.0.1", "123-45-6789", "000-12-3456", "x", "1 2 3", "88 77", "é", "\x02", "\x02A", "\x02z"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "-", "  ", ", ", ""]) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    texts += [c + " 12/27" for c in cards] + ["555 " + c for c in cards] + cards
    got = replaced(spark, texts)
    assert got == [brute(t) for t in texts]
    assert all(c not in " ".join(got[-18:]) for c in cards[:5])


def test_the_key_takes_pseudonyms_back():
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice("0123456789abzAZ.-") for _ in range(rng.randint(1, 30)))
        assert permuted_text(permuted_text(text, "email"), "email", back=True) == text


@pytest.mark.parametrize("text", ["x@" + "a." * 300_000, "a@" * 300_000, "9" * 600_000, "1.1." * 150_000, "+1 " * 200_000, "2021-03-" * 70_000, "123-45-" * 80_000, "\x02" * 300_000], ids=lambda t: t[:8])
def test_long_texts_of_what_patterns_begin_with(spark, text):
    assert replaced(spark, [text, "card 4111 1111 1111 1111"])[0] == text


def test_dates_after_numbers_and_unknown_formats(spark):
    texts = ["order 48213 2021-03-04 shipped", "call 555-123-4567 on 03/14/2021", None, ""]
    got = replaced(spark, texts)
    assert re.fullmatch(r"order 48213 \d{4}-\d\d-\d\d shipped", got[0]) and got[0] != texts[0]
    assert got[1:] == texts[1:]
