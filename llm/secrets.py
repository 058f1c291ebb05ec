"""Secret scans: fixed patterns, and random strings exposed by a tokenizer.

A vocabulary made from ordinary text spells words with few tokens, while a random string needs one
for every one or two characters. Strings of at least 20 key characters are encoded; those with few
characters per token are reported, or the parts of them between separators that have few.
Digests of known lengths, UUIDs, plain numbers, dates and names made of words are left out first.

A scan of each batch's bytes finds the texts that can have a match at all; patterns run on those.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.stages import slices, texts_of

# Kinds in their order, and the patterns of the first three.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = [b"passw", b"secret", b"token", b"api"]
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
# Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
KEY_LENGTH = 20
CHARS_PER_TOKEN = 2.0
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
DIGEST = re.compile(r"[0-9a-fA-F]+")
NUMBERS = re.compile(r"[0-9+/_=-]+")
# Possessive throughout: a run of separators has one way to match, however long it is.
IDENTIFIER = re.compile(r"[A-Za-z]++[0-9]*+(?:[_/-]++[A-Za-z]*+[0-9]*+)*+|[a-z]++(?:[A-Z][a-z]++)++[0-9]*+")
LETTERS = re.compile(r"[a-z]+|[A-Z]+")
PART = re.compile(r"[A-Za-z0-9]+")
WORDS = re.compile(r"[+/_=-]*+(?:(?:[A-Z]++|[A-Z]?[a-z]++)(?:[+/_=-]++|\Z))*+")
PART_LENGTH, REST_LENGTH = 8, 4
PLACEHOLDER = "[secret]"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    """One tokenizer per worker and file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("keys", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known_identifier(value: str) -> bool:
    """Digests, UUIDs, numbers and names made of words aren't secrets."""
    if UUID.fullmatch(value) or NUMBERS.fullmatch(value):
        return True
    if DIGEST.fullmatch(value) and len(value) in DIGEST_LENGTHS:
        return True
    # Letters of one case have the form of a name whatever they are; their tokens tell.
    if LETTERS.fullmatch(value):
        return False
    if WORDS.fullmatch(value):
        return True
    # A name has few changes between cases and digits for its length.
    changes = sum(a.islower() != b.islower() or a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
    return bool(IDENTIFIER.fullmatch(value)) and 5 * changes < len(value)


def is_random(value: str, path: str, ratio: float) -> bool:
    """Few characters per token."""
    return len(value) < ratio * len(encoding(path).encode_ordinary(value))


def random_strings(text: str, path: str, ratio: float) -> list[tuple[int, int]]:
    """Runs of key characters that are random as a whole, else their random parts between separators."""
    found = []
    for match in CANDIDATE.finditer(text):
        value = match[0].strip("=-_/+")
        if len(value) < KEY_LENGTH:
            continue
        start = match.start() + match[0].index(value)
        if not known_identifier(value) and is_random(value, path, ratio):
            found.append((start, start + len(value)))
        else:
            found += [(start + a, start + b) for a, b in random_parts(value, path, ratio)]
    return found


def random_parts(value: str, path: str, ratio: float) -> list[tuple[int, int]]:
    """The places of neighbouring parts of ``value`` that are random together, so that an ordinary
    prefix, suffix or path doesn't hide a secret, nor a separator inside one its length."""
    if UUID.fullmatch(value) or NUMBERS.fullmatch(value) or len(value) < KEY_LENGTH:
        return []
    parts = [(m.start(), m.end()) for m in PART.finditer(value)]
    if len(parts) < 2:
        return []
    # Characters that a random string of as many tokens would have to spare; ordinary words are below nothing.
    spare = [ratio * len(encoding(path).encode_ordinary(value[a:b])) - (b - a) for a, b in parts]
    found, k = [], 0
    while k < len(parts):
        total, best, last = 0.0, 0.0, None
        for j in range(k, len(parts)):
            total += spare[j]
            if total <= 0:
                break
            if total > best:
                best, last = total, j
        if last is None:
            k += 1
            continue
        # Paths of short words have many tokens too, but no long part that has.
        long = any(b - a >= PART_LENGTH and x > 0 for (a, b), x in zip(parts[k : last + 1], spare[k : last + 1]))
        for a, b in [(parts[k][0], parts[last][1])] * long + parts[k : last + 1]:
            if b - a >= KEY_LENGTH and not known_identifier(value[a:b]) and is_random(value[a:b], path, ratio):
                if not found or found[-1][1] <= a:
                    found.append((a, b))
        k = last + 1
    return found


def uncovered(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the sorted ``spans`` leave of a run."""
    left = []
    for a, _, b in spans:
        if b > start and a < end:
            if a > start:
                left.append((start, a))
            start = max(start, b)
    return [*left, (start, end)] if start < end else left


def spans_of(text: str, path: str, ratio: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Start, kind (a place in KINDS) and end of all secrets, in order; positions in code points."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(spans)
    for start, end in random_strings(text, path, ratio):
        left = uncovered(start, end, base)
        if left != [(start, end)]:
            # Names before or behind a secret are no part of it.
            left = [
                (a, b) for a, b in left
                if b - a >= REST_LENGTH and not WORDS.fullmatch(text[a:b]) and is_random(text[a:b], path, ratio)
            ]
        spans += [(a, 3, b) for a, b in left]
    return sorted(spans)


@lru_cache(maxsize=1)
def byte_classes() -> np.ndarray:
    """1 for the characters of a key, 3 for those that are also lower-case hexadecimal."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = 1
    kinds[list(b"0123456789abcdef")] = 3
    return kinds


def suspects(encoded: list[bytes]) -> list[int]:
    """Texts that may have a match: a keyword, or a run of key characters that is long enough."""
    whole = b"\n".join(encoded) + b"\n"
    inside = np.concatenate([[0], byte_classes()[np.frombuffer(whole, np.uint8)] & 1]).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    starts = edges[::2][edges[1::2] - edges[::2] >= min(KEY_LENGTH, ACCESS_LENGTH, HEX_LENGTH)]
    ends = np.cumsum([len(e) + 1 for e in encoded])
    found = set(np.searchsorted(ends, starts, "right").tolist())
    for k, text in enumerate(encoded):
        if k not in found:
            lower = text.lower()
            if any(word in lower for word in KEYWORDS):
                found.add(k)
    return sorted(found)


def scan(texts: list[str | None], path: str, ratio: float) -> list[list[tuple[int, int, int]]]:
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k in suspects([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        spans[k] = spans_of(texts[k] or "", path, ratio)
    return spans


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(
    df: DataFrame, path: str | None = None, ratio: float = CHARS_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, by start and kind) of every text.

    Null and empty texts have no spans; null ids are kept; repeated rows give repeated results; an
    empty table gives an empty one. Other columns are ignored, whatever their names. Texts are
    scanned whole. Matches of a kind don't overlap; different kinds can, but of a random string only
    what nothing else covers is reported.
    """
    path = path or default_vocabulary()
    source = texts_of(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            spans = scan(batch["text"].to_pylist(), path, ratio)
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own] for own in spans]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, kind)], ["doc_id", "spans"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    pieces, at = [], 0
    for start, _, end in spans:
        if start >= at:
            pieces += [text[at:start], PLACEHOLDER]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def redact(df: DataFrame, path: str | None = None, ratio: float = CHARS_PER_TOKEN, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every secret of the text replaced; a null text stays null."""
    path = path or default_vocabulary()
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(place).to_pylist()
            spans = scan(texts, path, ratio)
            new = pa.array([masked(t, s) if s else t for t, s in zip(texts, spans)], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(
                [new if k == place else c for k, c in enumerate(batch.columns)], batch.schema.names
            )

    return df.mapInArrow(run, df.schema)


def counted(found: DataFrame) -> DataFrame:
    """Counts, digest of the pattern spans and a list of all spans, from ``find_secrets``."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
