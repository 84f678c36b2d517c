"""Personal data replaced by format-preserving pseudonyms: keyed Feistel permutations within each format.

Card numbers (Luhn-valid), IPv4 addresses, dates, social security numbers, telephone numbers and e-mail
addresses are found by pattern, validated, and permuted among the values of their own format. Each step is
invertible with the key, so different values keep different pseudonyms, and equal values the same one in
every document. Only column expressions: one pass over the table, without a shuffle.

Numbers may stand side by side. All formats but cards are taken first, from left to right. In what is left a card begins
where a group of digits begins and ends where one ends; its groups are joined by single blanks or hyphens. Where several
fit, the one that begins first and then the longest is taken, and the search goes on behind it. No pattern repeats
a group without a small bound, so a text of any length and content needs no deep recursion of the matcher.

What stays: the domain of an e-mail address, a telephone number's country code. A local part of one character only moves
within its class. Not known: telephone numbers without "+" and country code, dates other than year-month-day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let

KEY = "popmeasure example key: give your own"
ROUNDS = 8
#: Patterns of the formats. Each begins where no longer word or number could have begun.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?>[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
DATE = r"(?<![\d-])(?:1[89]|2[01])\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d]|-\d)"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d]|-\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d(?:[ -]?\d){5,11}(?!\d)"
ANY = "|".join((EMAIL, IP, SSN, DATE, PHONE))
#: The longest text from the start of a group of digits that may hold a card, seen from there; digits of a card.
CARD_START, CARD_SIZES = r"(?<!\d)(?=(\d(?:[ -]?\d){12,18})(?!\d))", range(19, 12, -1)
#: Goes before a card that is found, with a capital letter for its digits; "z" follows it where a text has it already.
MARK = "\x02"
KINDS = ["email", "ip", "ssn", "date", "phone", "card"]
#: Any 400 years of the calendar have 146,097 = 189 * 773 days.
FIRST_DAY, DAY_PARTS = "1800-01-01", (189, 773)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _digest(key: str, kind: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)


def permuted(value: Column, parts: tuple[int, int], key: str, kind: str) -> Column:
    """A permutation of 0 .. a * b - 1: a Feistel network over value = left * b + right, each side's sum taken modulo its own size."""
    a, b = parts

    def turn(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, (s["left"] + _number(_digest(key, kind, i, s["right"]))) % a).otherwise(s["left"])
        right = F.when(i % 2 == 1, (s["right"] + _number(_digest(key, kind, i, s["left"]))) % b).otherwise(s["right"])
        return F.struct(left.alias("left"), right.alias("right"))

    start = F.struct(F.floor(value / b).cast("long").alias("left"), (value % b).cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["left"] * b + s["right"])


def _shifted(part: Column, digest: Column) -> Column:
    """Each letter and digit of part moved within its class by two hexadecimal digits of the digest; others stay."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        within = lambda first, size: F.chr((F.ascii(c) - ord(first) + by) % size + ord(first))
        return F.when(c.between("0", "9"), within("0", 10)).when(c.between("a", "z"), within("a", 26)).when(c.between("A", "Z"), within("A", 26)).otherwise(c)

    return F.array_join(F.transform(F.split(part, "(?!^)(?!$)"), move), "")


def permuted_text(text: Column, key: str, kind: str) -> Column:
    """A permutation of the texts with the same places of digits, small and capital letters: a Feistel network over the two halves."""
    half = F.floor(F.length(text) / 2).cast("int")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")

    def turn(s: Column, i: Column) -> Column:
        moved = lambda part, other: let(_digest(key, kind, i, F.concat_ws("|", shape, other)), lambda d: _shifted(part, d))
        left = F.when(i % 2 == 0, moved(s["left"], s["right"])).otherwise(s["left"])
        right = F.when(i % 2 == 1, moved(s["right"], s["left"])).otherwise(s["right"])
        return F.struct(left.alias("left"), right.alias("right"))

    start = F.struct(F.substring(text, F.lit(1), half).alias("left"), F.substring(text, half + 1, F.length(text)).alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["left"], s["right"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _spread(shape: Column, digits: Column) -> Column:
    """digits laid into the places that digits have in shape."""
    places = F.transform(F.split(shape, "(?!^)(?!$)"), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c))
    return F.array_join(places, "")


def _card(found: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is then what makes the number valid."""
    digits = _digits(found)
    body = permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    valid = lambda b: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(b, d.cast("string"))), lambda n: F.call_function("luhn_check", n))
    return let(let(body, lambda b: F.element_at(valid(b), 1)), lambda new: _spread(found, new))


def _ip(found: Column, key: str) -> Column:
    parts = F.transform(F.split(found, r"\."), lambda p: p.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda v, p: v * 256 + p)
    new = permuted(value, (65536, 65536), key, "ip")
    return let(new, lambda v: F.concat_ws(".", *(F.shiftrightunsigned(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))))


def _date(found: Column, key: str) -> Column:
    """Any day of the 400 years from FIRST_DAY."""
    day = F.datediff(F.try_to_timestamp(found, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), permuted(day, DAY_PARTS, key, "date").cast("int")), "yyyy-MM-dd")


def _ssn(found: Column, key: str) -> Column:
    """898 areas, 99 groups and 9999 serials are valid."""
    area = F.substring(found, 1, 3).cast("long")
    value = ((area - 1 - (area > 666).cast("long")) * 99 + F.substring(found, 5, 2).cast("long") - 1) * 9999 + F.substring(found, 8, 4).cast("long") - 1

    def text(v: Column) -> Column:
        low = F.floor(v / (99 * 9999)).cast("long") + 1
        area = low + (low >= 666).cast("long")
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(v / 9999) % 99 + 1).cast("long").cast("string"), 2, "0"), F.lpad((v % 9999 + 1).cast("string"), 4, "0"))

    return let(permuted(value, (898 * 99, 9999), key, "ssn"), text)


def _phone(found: Column, key: str) -> Column:
    """The country's digits stay: those up to the first separator, or the first two."""
    head = F.regexp_extract(found, r"^\+(?:\d{1,3}(?=[ (-])|\d\d)", 0)
    return F.concat(head, permuted_text(F.substring(found, F.length(head) + 1, F.length(found)), key, "phone"))


def _email(found: Column, key: str) -> Column:
    at = F.call_function("instr", found, F.lit("@"))
    return F.concat(permuted_text(F.substring(found, F.lit(1), at - 1), key, "email"), F.substring(found, at, F.length(found)))


def kind_of(found: Column) -> Column:
    """Kind of a string that ANY has matched; null if it isn't valid."""
    whole = lambda p: found.rlike(rf"^(?:{p})$")
    date = whole(DATE) & F.try_to_timestamp(found, F.lit("yyyy-MM-dd")).isNotNull()
    return F.when(found.contains("@"), "email").when(whole(IP), "ip").when(whole(SSN), "ssn").when(date, "date").when(found.startswith("+"), "phone")


def pseudonym(found: Column, key: str = KEY) -> Column:
    """The pseudonym of a string that ANY has matched; the string itself if it isn't valid."""

    def of(kind: Column) -> Column:
        out = F.when(kind == "email", _email(found, key))
        for name, make in (("ip", _ip), ("ssn", _ssn), ("date", _date), ("phone", _phone)):
            out = out.when(kind == name, make(found, key))
        return out.otherwise(found)

    return let(kind_of(found), of)


def _run(size: int) -> str:
    """A card of so many digits from its start on, with what stands between them."""
    return rf"\d(?:[ -]?\d){{{size - 1}}}(?!\d)"


def _card_letter(longest: Column) -> Column:
    """A letter for the number of digits of the longest valid card that the candidate begins with; empty if there is none."""
    out = F.lit("")
    for k in reversed(CARD_SIZES):
        own = F.regexp_extract(longest, "^" + _run(k), 0)
        out = F.when((own != "") & F.call_function("luhn_check", _digits(own)), chr(ord("A") + k - 13)).otherwise(out)
    return out


def with_cards(part: Column, key: str) -> Column:
    """part with its cards replaced, and how many: text, n. Starts of valid cards are marked, and the matcher then takes the marked ones from left to right."""
    between = rf"[ -]?(?:{MARK}[A-G])?"
    marked = "|".join(rf"{MARK}{chr(ord('A') + k - 13)}\d(?:{between}\d){{{k - 1}}}(?!\d)" for k in CARD_SIZES)
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, rf"{MARK}[A-G]", ""), rf"{MARK}z", MARK)

    def replaced(text: Column) -> Column:
        letters = F.transform(F.regexp_extract_all(text, F.lit(CARD_START), F.lit(1)), _card_letter)
        pieces = F.split(text, CARD_START, -1)
        # A split never begins with an empty piece where the first start is the text's start: then pieces are as many as starts.
        none = F.slice(F.array(F.lit("")), F.lit(1), F.size(pieces) - F.size(letters))
        signs = F.concat(none, F.transform(letters, lambda c: F.when(c != "", F.concat(F.lit(MARK), c)).otherwise("")))
        return let(F.array_join(F.zip_with(signs, pieces, lambda a, b: F.concat(a, b)), ""), taken)

    def taken(text: Column) -> Column:
        cards = F.regexp_extract_all(text, F.lit(marked), F.lit(0))
        rest = F.transform(F.split(text, marked, -1), plain)
        new = F.transform(cards, lambda c: let(plain(c), lambda own: _card(own, key)))
        return F.struct(F.array_join(F.zip_with(rest, new, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "").alias("text"), F.size(cards).alias("n"))

    escaped = F.regexp_replace(part, MARK, MARK + "z")
    return F.when(part.rlike(CARD_START), let(escaped, replaced)).otherwise(F.struct(part.alias("text"), F.lit(0).alias("n")))


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with personal data in text replaced, and the added column found (array of kinds, in order of place; clashing column replaced).

    Null texts stay null and have nothing found, as do empty ones. Row by row: repeated rows and other columns
    stay, an empty table stays empty. Equal values have equal pseudonyms, in whatever row; order and ties change nothing.
    """
    none = F.array().cast("array<string>")
    some = F.col("text").rlike("[0-9]|@")
    matches = F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none)
    between = F.when(some, F.transform(F.split("text", ANY, -1), lambda p: with_cards(p, key)))
    marked = docs.withColumn("__matches", F.coalesce(matches, none)).withColumn("__between", between)
    new = F.array_join(F.zip_with("__between", F.transform("__matches", lambda m: pseudonym(m, key)), lambda p, m: F.concat(p["text"], F.coalesce(m, F.lit("")))), "")
    kinds = F.zip_with("__between", F.transform("__matches", kind_of), lambda p, k: F.concat(F.array_repeat(F.lit("card"), p["n"]), F.array_compact(F.array(k))))
    return marked.withColumns({"found": F.coalesce(F.flatten(kinds), none), "text": F.when(some, new).otherwise(F.col("text"))}).drop("__matches", "__between")


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and how many values of each kind were replaced, of every document."""
    rows = pseudonymised(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda k: k == kind)).cast("long")
    return rows.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), *(count(k).alias(f"n_{k}") for k in KINDS))
