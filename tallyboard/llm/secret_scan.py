r"""Secret scans: fixed patterns, and zstandard novelty primed with dictionaries.

Beside the patterns' spans, every long token in a sensitive line (one that holds a word such as ``key`` or ``credential``,
before or after the token, near or far) is a candidate; in ``NAME=VALUE`` the value is one by itself. Its novelty is the
number of bytes by which it lengthens the compressed form of its surroundings, with dictionaries and the text around it,
without its own repetitions, as prior content. There are two dictionaries: common identifiers, a parameter, and the corpus'
own long words, those that most documents hold outside sensitive lines. A known word costs a few bytes, a random key nearly
its length; incompressible ones are reported as ``novel``, whatever characters they are made of. Tokens without a digit, which
may be words that no dictionary has, need a higher share.

Texts that hold none of the patterns' fixed parts are set aside by one vectorised test each, which never loses a match.
Nothing leaves its row, so hot sources and repeated rows need no shuffle; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import chunks, filled

#: Fixed values of the base: kinds in order, pattern, least length and the group that it counts for.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 12, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 16, 0),
]
#: hex runs of at least the least length are the runs of [0-9a-f]+ that pass
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
#: Words that make their line a sensitive one.
SENSITIVE = r"credential|bearer|private|auth|signature|secret|token|passw|pwd|passphrase|api[_ -]?key|_key|\bkey"
CONTEXT = re.compile(f"(?i){SENSITIVE}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Where a token can begin in a run: at its start and after each '='.
PIECE = re.compile(r"(?:^|(?<==))[^=]")
DIGIT = re.compile(r"[0-9]")
LEAST_TOKEN = 16
#: What a text with any span matches. Python takes dotless and dotted i for i where RE2 doesn't.
MAYBE = [r"(?i)password|passwd|secret|token|api_?key", "AKIA", "[0-9a-f]{16}", f"(?i){SENSITIVE}|[\u0130\u0131]"]

AROUND = 400
#: Least novelty: bytes per character, of tokens without a digit (which may be words), and bytes in all.
NOVELTY, WORD_NOVELTY, LEAST_BYTES = 0.5, 0.9, 12

IDENTIFIERS = (
    # parts of long words
    "inter nation international isation ization ation tion sion ment ness ability ibility ition ution ically ingly fully ologie "
    "graph phone tele trans under over counter super electro micro multi auto bio psych struct form press port vers duct "
    "schaft heit keit ungen ungs lich bung gesell geschwindig entwicklung verwaltung versicherung "
    "ement issement iquement aison ique eur euse ción miento mente idad ador "
    # names in code and configuration
    "password passwd secret token api_key apikey access_key secret_key private_key public_key credential credentials authorization "
    "authentication bearer signature certificate client_id client_secret session_id request_id user_name username config configuration "
    "environment settings connection database localhost default_placeholder_name example_value placeholder changeme your_token_here "
    "name_of_the_host host_of_the_database path_of_the_file number_of_users insert_your_key_here "
    "xxxxxxxxxxxxxxxx ---------------- ________________ ================ ++++++++++++++++ 0123456789 1234567890 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ import return function class public static private protected "
    "string integer boolean float double const let var def self this null none true false http https www com org "
    "/usr/local/share/lib/bin /home/user/ src/main/resources/ application/json index.html README"
).encode()


#: Words of the corpus that prime the compressor: letters at least, and the most that are taken.
LONG_WORD, LONG_WORDS = re.compile(r"[A-Za-z]{16,}"), 1000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches, leftmost and non-overlapping per kind."""
    found = []
    for k, (kind, pattern, least, group) in enumerate(BASE):
        pattern = HEX_RUN if kind == "hex" else pattern
        found += [(m.start(), m.end(), k) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda x: (x[0], x[2]))


def novelty(candidate: str, around: str, identifiers: bytes = IDENTIFIERS) -> int:
    """Bytes that the candidate adds to the compressed form of its surroundings, whatever the case of letters."""
    prior = around.lower().encode()
    known = zstandard.ZstdCompressionDict(identifiers.lower() + b"\n" + prior, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_dict_id=False)
    tail = prior[-64:]
    return len(packer.compress(tail + candidate.lower().encode())) - len(packer.compress(tail))


def surroundings(text: str, a: int, b: int) -> str:
    """The text on both sides of text[a:b], with other occurrences of it blanked, those that the limits cut included."""
    token, blank = text[a:b], " " * (b - a)
    before = text[max(0, a - AROUND - len(token)) : a].replace(token, blank)[-AROUND:]
    return before + text[b : b + AROUND + len(token)].replace(token, blank)[:AROUND]


def sensitive_lines(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every line that holds a sensitive word."""
    at = 0
    while m := CONTEXT.search(text, at):
        end = text.find("\n", m.end())
        yield text.rfind("\n", 0, m.start()) + 1, len(text) if end < 0 else end
        if end < 0:
            return
        at = end + 1


def novel_spans(text: str, taken: list[tuple[int, int, int]], share: float = NOVELTY, word_share: float = WORD_NOVELTY, least: int = LEAST_BYTES, identifiers: bytes = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """Spans (kind number 3) of incompressible tokens in sensitive lines that no span in `taken` touches."""
    found = []
    for begin, end in sensitive_lines(text):
        for m in RUN.finditer(text, begin, end):
            stop = m.end()
            # from the last piece back, so that a value is weighed before NAME=VALUE as a whole
            for a in [m.start() + x.start() for x in PIECE.finditer(m[0])][::-1]:
                if stop - a < LEAST_TOKEN or any(x < stop and a < y for x, y, _ in taken):
                    continue
                extra = novelty(text[a:stop], surroundings(text, a, stop), identifiers)
                if extra >= least and extra >= (share if DIGIT.search(text, a, stop) else word_share) * (stop - a):
                    found.append((a, stop, 3))
                    stop = m.start() + len(text[m.start() : a].rstrip("="))
    return found


KINDS = [kind for kind, *_ in BASE] + ["novel"]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _maybe(texts: pa.Array):
    """Which texts can hold a span at all."""
    out = pc.match_substring_regex(texts, MAYBE[0])
    for pattern in MAYBE[1:]:
        out = pc.or_(out, pc.match_substring_regex(texts, pattern))
    return out.to_pylist()


def corpus_words(docs: DataFrame, most: int = LONG_WORDS) -> bytes:
    """The long words that most rows of `docs` hold outside sensitive lines, two rows at least; counted over all rows, `most` of them reach the driver."""

    def run(batches):
        for part in chunks(batches):
            words = []
            for text in part.column(0).filter(pc.match_substring_regex(part.column(0), LONG_WORD.pattern)).to_pylist():
                plain, at = [], 0
                for a, b in sensitive_lines(text):
                    plain.append(text[at:a])
                    at = b
                words += {w for x in [*plain, text[at:]] for w in LONG_WORD.findall(x)}
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    counted = docs.select(filled().alias("text")).mapInArrow(run, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # the commonest last, where the compressor finds them nearest
    return " ".join(r.word for r in counted.orderBy(F.col("n").desc(), "word").limit(most).collect()[::-1]).encode()


def find_secrets(docs: DataFrame, identifiers: bytes = IDENTIFIERS) -> DataFrame:
    """doc_id, kind, start, stop, secret: every span with its text. Null and empty texts have none, very long ones are scanned whole,
    repeated rows alike; no rows give none. Other columns are ignored, whatever their names."""
    known = identifiers + b" " + corpus_words(docs)

    def run(batches):
        for part in chunks(batches):
            rows = []
            for i, maybe in enumerate(_maybe(part.column(1))):
                if maybe:
                    text, own = part.column(1)[i].as_py(), part.column(0)[i].as_py()
                    base = base_spans(text)
                    rows += [(own, KINDS[k], a, b, text[a:b]) for a, b, k in sorted(base + novel_spans(text, base, identifiers=known), key=lambda x: (x[0], x[2]))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "kind", "start", "stop", "secret"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text"))
    return rows.mapInArrow(run, "doc_id long, kind string, start long, stop long, secret string")


def secret_digest(docs: DataFrame, identifiers: bytes = IDENTIFIERS) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 (of kind:start:end, comma-joined) and spans (all, the method's too).

    Nulls, empty and very long texts and repeated rows as in `find_secrets`."""
    empty, known = hashlib.sha256(b"").hexdigest(), identifiers + b" " + corpus_words(docs)

    def run(batches):
        for part in chunks(batches):
            counts, digest, spans = [[0] * part.num_rows for _ in BASE], [empty] * part.num_rows, [""] * part.num_rows
            for i, maybe in enumerate(_maybe(part.column(1))):
                if maybe:
                    text = part.column(1)[i].as_py()
                    base = base_spans(text)
                    for _, _, k in base:
                        counts[k][i] += 1
                    digest[i] = hashlib.sha256(_listed(base).encode()).hexdigest()
                    spans[i] = _listed(sorted(base + novel_spans(text, base, identifiers=known), key=lambda x: (x[0], x[2])))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
