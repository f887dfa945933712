"""Secret scan: fixed patterns, and strings that a primed compressor finds novel.

Patterns give the base spans. Beyond them, every long string that follows a sensitive word
closely is a candidate: its marginal compressed size, by zstandard primed with the
identifiers that code commonly has and with the text around the candidate, tells how much
of it is neither a known name nor repeated nearby. Candidates that stay nearly as long as
they are, or as random strings of their length and alphabet, get reported. Names of classes
and paths are as long and as new as many a key, so candidates without a digit are measured a
second time: behind a carrier of words, with the words of most documents of the corpus as the
dictionary, against the mean of random strings there. Base spans stay whatever the compressor
says.

Edge cases: a null or empty text has no spans; texts are scanned whole; repeated rows give
repeated results; an empty table gives an empty result; where all texts together have few words
or none, those of the identifiers are the dictionary. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import cycle

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import text_parts

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
#: Lower-case strings of which each match of ASSIGN has one; lower-casing can only add hits.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 32 or more is a match of [0-9a-f]+ that is long enough.
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

SENSITIVE_WORDS = ASSIGN_WORDS + ("credential", "private key", "access key", "bearer", "authorization", "pwd", "passphrase")
SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE_WORDS)), re.IGNORECASE | re.ASCII)
LEAST_CHARS = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
CANDIDATE_START = re.compile(r"[A-Za-z0-9+/_=-]{%d}" % LEAST_CHARS)
#: A candidate starts at most so many code points after the sensitive word's end.
REACH = 48
#: Code points of context on each side that prime the compressor.
CONTEXT = 1024
#: Marginal compressed bytes for each byte of a candidate from which it is novel, as a share of
#: what a random string of its length and alphabet takes (of one byte, if that is less).
NOVELTY = 0.8
#: A candidate's alphabet is the first of these that has all its characters, else the union of
#: the classes (digits, lower case, upper case, others) that it has characters of.
ALPHABETS = ("0123456789", "0123456789ABCDEF", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase, "+/_=-")
#: Bytes of the corpus's most common words that prime the compressor for candidates without a digit.
DICTIONARY_BYTES = 32768
#: Bytes of further words that such a candidate is compressed behind: alone, zstandard stores a
#: short string as it is, word or not.
CARRIER_BYTES = 1024
#: Letters of the words in the dictionary; the longest are shorter than a candidate.
WORD_CHARS = (4, LEAST_CHARS - 1)
#: The share of a random string's size behind the carrier from which such a candidate is novel.
UNLIKE_WORDS = 0.75
#: Random strings whose mean is what a random string takes behind the carrier.
DRAWS = 16
#: Identifiers that commonly follow sensitive words in code without being secrets.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret client_id credential "
    "authorization bearer authenticate authentication configuration environment variable parameter argument "
    "settings options default undefined function return import export const static public private protected "
    "string number boolean integer object array request response header session cookie username user_name "
    "account identifier database connection endpoint https:// http:// localhost example.com placeholder "
    "get set create update delete find list handler manager builder factory provider service controller listener "
    "dispatcher executor context exception interface instance register abstract internal application "
    "changeme your_api_key_here your-secret-here getenv process.env os.environ System.getProperty "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 -----BEGIN -----END"
)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the pattern matches, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes of ``candidate`` for each of its bytes.

    Further copies of it nearby do not make it known."""
    around = f"{after}\n{before}".replace(candidate, "")
    known = f"{IDENTIFIERS}\n{around}".encode()
    primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False).compress
    data = candidate.encode()
    return (len(compress(data)) - len(compress(b""))) / len(data)


def alphabet(candidate: str) -> str:
    has = set(candidate)
    known = next((a for a in ALPHABETS if has.issubset(a)), None)
    return known or "".join(c for c in CLASSES if has.intersection(c))


@lru_cache(4096)
def random_novelty(letters: str, length: int) -> float:
    """:func:`novelty` of a random string (the same one each time)."""
    return novelty("".join(random.Random(length).choices(letters, k=length)), "", "")


class Vocabulary:
    """A compressor primed with common words, the most common first."""

    def __init__(self, words: Iterable[str], carrier_bytes: int = CARRIER_BYTES):
        known = "\n".join(words).encode()
        carried = known[-carrier_bytes:].split(b"\n")
        self.carrier = b"".join(word + joint for word, joint in zip(carried, cycle((b"_", b"/", b"-"))))
        # What is most common comes last, where it takes fewest bits to point at.
        rest = known[:-carrier_bytes].split(b"\n")
        primed = b"\n".join(rest[::-1]) + b"\n" + IDENTIFIERS.lower().encode()
        dictionary = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(
            level=19, dict_data=dictionary, write_checksum=False, write_content_size=False
        ).compress
        self.alone = len(self.compress(self.carrier))
        self.expected: dict[tuple[str, int], float] = {}

    def novelty(self, candidate: str) -> float:
        """Marginal compressed bytes for each byte of ``candidate``, in lower case, behind the carrier."""
        data = candidate.lower().encode()
        return (len(self.compress(self.carrier + data)) - self.alone) / len(data)

    def random_novelty(self, letters: str, length: int) -> float:
        """The mean :meth:`novelty` of random strings (the same ones each time)."""
        place = letters, length
        if place not in self.expected:
            if len(self.expected) >= 4096:
                self.expected.clear()
            draw = random.Random(length)
            drawn = ("".join(draw.choices(letters, k=length)) for _ in range(DRAWS))
            self.expected[place] = sum(map(self.novelty, drawn)) / DRAWS
        return self.expected[place]


@lru_cache(4)
def vocabulary(words: tuple[str, ...]) -> Vocabulary:
    return Vocabulary(words)


#: Without a corpus, the words of the identifiers are the common ones.
PLAIN_WORDS = tuple(dict.fromkeys(re.findall("[a-z]{%d,%d}" % WORD_CHARS, IDENTIFIERS.lower())))


def common_words(docs: DataFrame, text: str = "text", dictionary_bytes: int = DICTIONARY_BYTES) -> tuple[str, ...]:
    """The words (parts of identifiers, lower case) of most documents, of all texts, the most
    common first: as many as ``dictionary_bytes`` and the carrier hold, ties by the word. So what
    comes to the driver, and goes to tasks, has that bound. If they are fewer, the words of the
    identifiers follow."""
    low, high = WORD_CHARS
    room = dictionary_bytes + CARRIER_BYTES
    parts = F.regexp_extract_all(F.col(text), F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))
    sized = F.filter(parts, lambda w: F.length(w).between(low, high))
    words = docs.select(F.explode(F.array_distinct(F.transform(sized, F.lower))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(room // (low + 1))
    out = []
    for row in top.collect():
        room -= len(row.word) + 1
        if room < 0:
            break
        out.append(row.word)
    else:
        out += PLAIN_WORDS
    return tuple(dict.fromkeys(out))


def is_novel(candidate: str, before: str, after: str, words: tuple[str, ...] = PLAIN_WORDS) -> bool:
    """Whether the compressor finds ``candidate`` new: against its surroundings and the
    identifiers, and, if it has no digit, against the common words as well."""
    letters = alphabet(candidate)
    if novelty(candidate, before, after) < NOVELTY * min(1, random_novelty(letters, len(candidate))):
        return False
    if any(c.isdigit() for c in candidate):
        return True
    known = vocabulary(words)
    return known.novelty(candidate) >= UNLIKE_WORDS * known.random_novelty(alphabet(candidate.lower()), len(candidate))


def novel_spans(
    text: str, base: list[tuple[int, str, int]], words: tuple[str, ...] = PLAIN_WORDS
) -> list[tuple[int, str, int]]:
    """Candidates in sensitive context that no base span touches and that stay incompressible,
    none in another: of a run that holds several words, what follows the first."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    taken = _union(sorted((a, b) for a, _, b in base))
    begins, ends = [a for a, _ in taken], [b for _, b in taken]
    near = _union([(m.end(), m.end() + REACH + 1) for m in SENSITIVE.finditer(text)])
    found, seen = [], 0
    for low_end, high_end in near:
        # A candidate that starts in reach may end beyond it; the search itself doesn't.
        at = max(low_end, seen)
        while at < high_end and (start := CANDIDATE_START.search(text, at, min(len(text), high_end + LEAST_CHARS - 1))):
            m = CANDIDATE.match(text, start.start())
            a, b = m.span()
            at = seen = b
            k = bisect_left(ends, a + 1)  # the first base span that ends after a
            if k == len(ends) or begins[k] >= b:
                around = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
                if is_novel(m[0], *around, words):
                    found.append((a, "novel", b))
    return found


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order of start, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("base_sha256", pa.string()), ("spans", pa.string())]
)
COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def _written(spans: list[tuple[int, str, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in ordered)


def scan(text: str, words: tuple[str, ...] = PLAIN_WORDS) -> tuple:
    base = base_spans(text)
    novel = novel_spans(text, base, words)
    kinds = [kind for _, kind, _ in base + novel]
    digest = hashlib.sha256(_written(base).encode()).hexdigest()
    return (*(kinds.count(k) for k in KINDS), digest, _written(base + novel))


def _scan_batches(words: tuple[str, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_parts(batches):
            found = list(zip(*(scan(t or "", words) for t in texts.to_pylist()), strict=True))
            arrays = [ids.cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(found, list(SCHEMA)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)

    return run


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dictionary_bytes: int = DICTIONARY_BYTES
) -> DataFrame:
    """One row per row of ``docs``: counts per kind, the digest of the base spans, and
    ``spans``, all as ``kind:start:end`` (code points, end exclusive) in order of start.

    The dictionary of common words is made from all texts first."""
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words = common_words(raw, dictionary_bytes=dictionary_bytes)
    return raw.mapInArrow(_scan_batches(words), COLUMNS)


def masked(text: str, spans: str) -> str:
    """``text`` with the spans' characters replaced by asterisks."""
    out = list(text)
    for span in filter(None, spans.split(",")):
        _, a, b = span.split(":")
        out[int(a) : int(b)] = "*" * (int(b) - int(a))
    return "".join(out)
