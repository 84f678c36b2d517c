"""Secrets: fixed patterns, and strings in a sensitive context that a primed compressor can't shorten.

Fixed kinds are assign, access and hex. The kind novel holds further strings: tokens near a sensitive word,
whose marginal cost is measured. The text before and after the token is compressed with zstandard, primed
with a dictionary, once with and once without the token; the difference, in bytes, for each byte of the token
is its novelty. Identifiers, words and strings that the surroundings repeat cost little; random keys cost near
their full entropy and are reported.

The dictionary holds general names of code and configuration, and before them what the table itself uses: its
most frequent long words, counted over the texts of all rows. Words with digits are left out, so that a key that
many copies of a text share doesn't become known. Its size is fixed.

One pass counts words (combined before the only shuffle), one pass measures; each text is handled by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ready

#: The kinds in the order that ties in start have, each with what must be long enough, and how long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "novel"]
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: A candidate: 16 (LEAST_LONG) to 8,192 (MOST_LONG) token characters with digits and letters, "=" at its end only; longer runs are data. Its context: a sensitive word, or the end of
#: a reported string, at most REACH characters before it. What joins a word to its value within a token is not part of the value.
TOKENS, JOINTS = re.compile(r"([A-Za-z0-9+/_-]{16,})={0,2}"), re.compile(r"[_-]*")
#: A private key's block: every line of its body is measured, whatever its distance from a sensitive word.
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(.*?)(?=-----END |\Z)", re.DOTALL)
LINE = re.compile(r"[A-Za-z0-9+/]{4,}={0,2}")
CONTEXT_WORDS = ("auth", "bearer", "credential", "passphrase", "private", "apikey", "api_key", "api-key", "access_key", "access-key", "client_id", "secret", "token", "password", "passwd", "pwd", "signature", "session")
SENSITIVE = re.compile("|".join(map(re.escape, CONTEXT_WORDS)), re.IGNORECASE | re.ASCII)
LEAST_LONG, MOST_LONG = 16, 8192
REACH, AROUND, RARE = 40, 400, 0.62
DIGITS, LETTERS = re.compile(r"[0-9]+"), re.compile(r"[A-Za-z]+")

#: Text that primes the compressor: names as code and configuration have them.
IDENTIFIERS = """
authorization authentication bearer basic credential credentials passphrase private_key public_key access_key access_token
refresh_token id_token client_id client_secret session_id session_token api_key api_secret secret_key signature certificate
username password config configuration environment variable settings default example placeholder changeme localhost
application/json text/html content-type user-agent accept-encoding https://www. http://api. .com/v1/ .org/ .net/ index.html
function return import from class def const let var public static void string integer boolean true false null none undefined
getElementById addEventListener toString valueOf prototype constructor interface implements extends package namespace
database connection timeout retry maximum minimum response request header payload message error exception warning debug info
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx
"""


#: Words of the table that the dictionary has at most, characters of them in all, and rows that must have a word.
WORDS, SIZE, ROWS = 4_000, 48_000, 3
GENERAL = IDENTIFIERS.encode()


def dictionary(docs: DataFrame) -> bytes:
    """The table's most frequent long words (by rows times length, then by name), the most frequent nearest to the end, and the general names after them."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_]{8,40}"), F.lit(0)))).alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= ROWS)
    top, size = [], 0
    for r in often.orderBy(F.desc(F.col("n") * F.length("word")), "word").limit(WORDS).collect():
        size += len(r["word"]) + 1
        if size <= SIZE:
            top.append(r["word"])
    return " ".join(reversed(top)).encode() + GENERAL


@lru_cache(maxsize=2)
def _compressor(known: bytes) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=6)
    return zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(before: str, token: str, after: str, known: bytes = GENERAL) -> float:
    """Bytes that the token adds to its compressed surroundings, for each of its own bytes."""
    size = lambda text: len(_compressor(known).compress(text.encode()))
    return (size(before + " " + after + " " + token) - size(before + " " + after)) / max(1, len(token.encode()))


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed kinds: leftmost and non-overlapping within a kind, short ones dropped afterwards."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]  # a run of 24 or more is what a run of any length leaves
    return sorted(out)


def _block_spans(text: str, known: bytes) -> list[tuple[int, int]]:
    """Lines of private keys' bodies. The body is measured as a whole: a short last line alone says too little."""
    out = []
    for block in BLOCK.finditer(text) if "PRIVATE KEY" in text else ():
        tokens = [(block.start(1) + m.start(), block.start(1) + m.end()) for m in LINE.finditer(block[1])]
        # Header lines such as "Proc-Type: 4,ENCRYPTED" have short tokens before the first long one.
        while tokens and tokens[0][1] - tokens[0][0] < 16:
            tokens.pop(0)
        body = "".join(text[a:b] for a, b in tokens)
        if body and novelty(text[max(0, block.start() - AROUND) : block.start(1)], body, "", known) >= RARE:
            out += tokens
    return out


class _Runs:
    """Runs of characters of a kind in a text, to ask about places and stretches by binary search."""

    def __init__(self, text: str, kind: re.Pattern):
        spans = [m.span() for m in kind.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def meet(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b


def novel_spans(text: str, taken: list[tuple[int, int, int]], known: bytes = GENERAL) -> list[tuple[int, int, int]]:
    """Further spans: candidates in a sensitive context that overlap no fixed span and whose novelty is at least RARE.

    The text's tokens are listed once; each context looks up the few that begin within its reach, so the work grows with the
    text's length and the number of candidates.
    """
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    held = bytearray(len(text))
    for a, _, b in taken:
        held[a:b] = b"\1" * (b - a)
    found = dict.fromkeys(s for s in _block_spans(text, known) if held.find(1, *s) < 0)
    for a, b in found:
        held[a:b] = b"\1" * (b - a)
    tokens = list(TOKENS.finditer(text))
    cores = [m.end(1) for m in tokens]
    digits, letters = (_Runs(text, kind) for kind in (DIGITS, LETTERS)) if tokens else (None, None)
    tried, contexts = set(), [m.end() for m in SENSITIVE.finditer(text)][::-1] if tokens else []
    while contexts:
        at = contexts.pop()
        # A value joined to the word is measured without the word.
        joined = JOINTS.match(text, at).end()
        for k in range(bisect_right(cores, joined), len(tokens)):
            m = tokens[k]
            a, b = max(m.start(), joined), m.end()
            if a > at + REACH:
                break
            # Not from within a longer token, unless that begins with the word and what joins it.
            if m.end(1) - a < LEAST_LONG or b - a > MOST_LONG or a > m.start() and not at < joined == a or (a, b) in tried:
                continue
            tried.add((a, b))
            if not digits.meet(a, b) or not letters.meet(a, b) or held.find(1, a, b) >= 0:
                continue
            if novelty(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND], known) >= RARE:
                found[a, b] = None
                held[a:b] = b"\1" * (b - a)
                contexts.append(b)
    return [(a, 3, b) for a, b in sorted(found)]


def scan(text: str | None, known: bytes = GENERAL) -> list[tuple[int, int, int]]:
    """All spans of a text in order of start, then kind. Offsets are code points; the end is exclusive."""
    if not text:
        return []
    fixed = fixed_spans(text)
    return sorted(fixed + novel_spans(text, fixed, known))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<kind:string,start:long,end:long>>"


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and secrets (array of kind, start, end) of each row of docs, in order of start, then kind.

    Null and empty texts have none. Repeated rows stay, an empty table stays empty, other columns are not read.
    Of spans that begin alike, the kinds' order decides.
    """
    ready(docs.sparkSession)
    known = dictionary(docs)

    def run(batches):
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t.as_py(), known)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN))], names=["doc_id", "secrets"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, secrets {SPANS}")


def hidden(text: str, known: bytes = GENERAL) -> str:
    """text with each secret replaced by <secret>; spans that overlap are one."""
    out, last = [], 0
    for a, _, b in scan(text, known):
        if a >= last:
            out += [text[last:a], "<secret>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced by <secret>, and n_chars (where there is such a column) counted anew for texts that changed.

    Null and empty texts stay as they are. Row by row: repeated rows and other columns, whatever their names, stay, and an empty table stays empty.
    """
    ready(docs.sparkSession)
    known = dictionary(docs)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for batch in batches:
            texts = [t if not t else hidden(t, known) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    old = docs.withColumn("__length", F.length("text"))
    new = old.mapInArrow(run, old.schema)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.length("text") != F.col("__length"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, how many spans each fixed kind has, their digest, all spans, and how many are novel, of every document."""
    rows = secret_spans(documents(spark, sf_dir))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"), count("novel").alias("n_novel"))
