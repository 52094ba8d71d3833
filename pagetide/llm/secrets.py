"""Secrets: patterns of known forms, and the token-efficiency test for strings of no form.

A vocabulary learned from natural text spends few tokens on words and many on random strings.
Long runs of the characters that keys are written in are counted in tokens; where fewer than
`EFFICIENCY` characters come on a token, the run is reported as `random`, unless it is a
digest of a known length, a UUID or a plain number. The parts of a run between `/` and `=` that
touch a span found by its form divide it into runs that are tested on their own. Where such a
run is not random as a whole, neighbouring parts of it that are, each on its own, are tested
together: a readable path does not hide the key behind it.

Spans are code points, end exclusive, of the whole match (an assignment with its name).

Defined results: null is the empty text, which has no spans; kinds may overlap (the digest in
an assignment is also `hex`); repeated rows are rows of their own; rows with null ids are kept;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EFFICIENCY = 1.9  # characters on a token
LEAST = 20  # characters of a run that is tested
PIECE = 256  # characters encoded at once, so that very long runs take linear time
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# whole runs only: the same as all runs of any length, without the short ones
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
_PART = re.compile(r"[^/=]+")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512
_DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]+")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(
        "vocabulary", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={}
    )


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        spans += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return _ordered(spans)


def _ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def known(run: str) -> bool:
    """A digest, a UUID or a number: random to look at, but no secret."""
    return bool(
        len(run) in _DIGESTS and _HEXADECIMAL.fullmatch(run) or _UUID.fullmatch(run) or _NUMBER.fullmatch(run)
    )


def tokens_of(run: str, encoding: tiktoken.Encoding) -> int:
    return sum(len(encoding.encode_ordinary(run[k : k + PIECE])) for k in range(0, len(run), PIECE))


def random_spans(text: str, found: list[tuple[int, int, str]], encoding: tiktoken.Encoding) -> list[tuple[int, int, str]]:
    spans = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        touching = [(x, y) for x, y, _ in found if x < b and a < y]
        if not touching:
            spans += _random_parts(text, a, b, encoding)
            continue
        parts = [(a + p.start(), a + p.end()) for p in _PART.finditer(m[0])]
        free = [not any(x < q and p < y for x, y in touching) for p, q in parts]
        for p, q in _groups(parts, free):
            spans += _random_parts(text, p, q, encoding)
    return spans


def _groups(parts: list[tuple[int, int]], chosen: list[bool]) -> list[tuple[int, int]]:
    """(first, end) of each sequence of chosen neighbours that is long enough for a test."""
    groups: list[tuple[int, int]] = []
    last = False
    for (p, q), now in zip(parts, chosen, strict=True):
        if now and last:
            groups[-1] = (groups[-1][0], q)
        elif now:
            groups.append((p, q))
        last = now
    return [(p, q) for p, q in groups if q - p >= LEAST]


def _random_parts(text: str, a: int, b: int, encoding: tiktoken.Encoding) -> list[tuple[int, int, str]]:
    """The run from a to b if it is random as a whole, else what is random between its readable parts."""
    run = text[a:b]
    if known(run):
        return []
    if b - a < EFFICIENCY * tokens_of(run, encoding):
        return [(a, b, "random")]
    parts = [p.span() for p in _PART.finditer(run)]
    if parts == [(0, b - a)]:
        return []
    odd = [not known(run[p:q]) and q - p < EFFICIENCY * tokens_of(run[p:q], encoding) for p, q in parts]
    return [(a + p, a + q, "random") for p, q in _groups(parts, odd)]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_FOUND = T.StructType(
    [
        *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def scanner(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A column function: text -> struct of counts, digest and spans. The vocabulary is sent along."""
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = pa.struct(
        [*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())]
    )

    @F.arrow_udf(_FOUND)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = encoder(shared.value)
        for column in texts:
            rows = []
            for text in column.to_pylist():
                base = base_spans(text or "")
                every = _ordered(base + random_spans(text or "", base, encoding))
                row = {f"n_{k}": sum(s[2] == k for s in every) for k in KINDS}
                row["base_sha256"] = hashlib.sha256(_joined(base).encode()).hexdigest()
                row["spans"] = _joined(every)
                rows.append(row)
            yield pa.array(rows, kind)

    return scan


def secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row."""
    scan = scanner(docs.sparkSession, vocabulary)
    return docs.select("doc_id", scan("text").alias("found")).select("doc_id", "found.*")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets(table(spark, folder, "documents"))


QUERIES = {"op7_secrets": op7_secrets}
ORACLES: dict[str, str] = {}  # SQL has no match positions; tests compare with a plain scan
