"""Secret scans: fixed formats, and a token-efficiency test for random strings.

A vocabulary of common text spends few tokens on words and many on random
characters. A run of key-like characters whose ratio of characters to tokens is
low is taken for a secret, unless it has the form of a digest or an identifier;
so is a part of it, since a readable name or path before a secret lifts the ratio.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from orbweave.llm.common import bounded_batches, clear_of, give_back, made, map_columns, resident, slices, texts

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]+")
_SEPARATORS = re.compile(r"[+/_=-]+")
_PART = re.compile(r"[^+/_=-]+")
_WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[0-9]{1,4}")

#: Letters are words from this share of the ratio on: random letters are mostly below, long compounds above.
WORD_SHARE = 0.9
#: Parts of so many characters must be words by themselves.
LONG_PART = 12


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    def make() -> tiktoken.Encoding:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return resident(("secrets", path, pattern), make)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three fixed formats, leftmost and non-overlapping for each."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def is_identifier(run: str, enc: tiktoken.Encoding, ratio: float) -> bool:
    """A digest of a known length, a UUID, a number, or words and short numbers joined as in names and paths.

    Letters are words only where their own ratio is high: long parts each for itself, short ones
    together and in lower case, since names in capitals take more tokens.
    """
    if _UUID.fullmatch(run) or _NUMBER.fullmatch(run) or (len(run) in _DIGEST_LENGTHS and _DIGEST.fullmatch(run)):
        return True
    parts = [p for p in _SEPARATORS.split(run) if p]
    words = [_WORDS.findall(p) for p in parts]
    whole = all("".join(w) == p for w, p in zip(words, parts, strict=True))
    n = sum(map(len, words))
    if not whole or sum(len(p) for p in parts) < 3.5 * n:
        return False
    lettered = [p for p in parts if not p.isdigit()]
    short = [p.lower() for p in lettered if len(p) < LONG_PART]
    groups = [[p] for p in lettered if len(p) >= LONG_PART] + [short] * bool(short)
    return all(sum(map(len, g)) >= WORD_SHARE * ratio * sum(len(enc.encode_ordinary(p)) for p in g) for g in groups)


def stretches(run: str, enc: tiktoken.Encoding, ratio: float) -> list[list[tuple[int, int]]]:
    """Stretches of a run that may hold a secret, from wide to narrow: all of it, what is left
    without the readable parts at its ends, its stretches without readable parts, its parts."""
    parts = [m.span() for m in _PART.finditer(run)]
    groups: list[list[tuple[int, int]]] = [[]]
    for a, b in parts:
        if is_identifier(run[a:b], enc, ratio):
            groups.append([])
        else:
            groups[-1].append((a, b))
    between = [(g[0][0], g[-1][1]) for g in groups if g]
    return [[(0, len(run))], [(between[0][0], between[-1][1])] if between else [], between, parts]


def random_spans(text: str, enc: tiktoken.Encoding, ratio: float, shortest: int) -> list[tuple[str, int, int]]:
    def is_random(part: str) -> bool:
        return len(part) >= shortest and len(part) < ratio * len(enc.encode_ordinary(part)) and not is_identifier(part, enc, ratio)

    found = []
    for m in _RUN.finditer(text):
        run = m[0].strip("=-_/+")
        if len(run) < shortest or is_identifier(run, enc, ratio):
            continue
        start, taken = m.start() + m[0].index(run), []
        for spans in stretches(run, enc, ratio):
            taken += [(a, b) for a, b in clear_of(spans, taken) if is_random(run[a:b])]
        found += [("random", start + a, start + b) for a, b in sorted(taken)]
    return found


def scan(text: str, enc: tiktoken.Encoding, ratio: float, shortest: int) -> tuple[list, list]:
    """The fixed formats' spans, and those with the random strings that overlap none of them."""
    base = base_spans(text)
    found = random_spans(text, enc, ratio, shortest)
    free = set(clear_of([s[1:] for s in found], [b[1:] for b in base]))
    more = [s for s in found if s[1:] in free]
    return base, sorted([*base, *more], key=_order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, last, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= end:
            out += [text[last:a], mark]
        end = max(end, b)
        last = end
    return "".join([*out, text[last:]])


def find_secrets(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = 2.2, shortest: int = 20) -> DataFrame:
    """Secrets in whole texts: one row for each input row, repeated ones too.

    Returns the id column, n_assign, n_access, n_hex, base_sha256 (of the fixed
    formats' spans) and spans (those and `random` ones). Offsets are code
    points, ends exclusive. A null text counts as empty: no spans, spans "".
    A null id stays null; other columns are ignored. `ratio` is the number of
    characters a token below which a run of at least `shortest`, or a part of it
    of that length, is random. Random strings of one case whose letters happen to
    be as dense as words are missed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def make():
        enc = encoding(path, pattern)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {id_col: batch.column(id_col)} | {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in texts(batch, text_col):
                base, spans = scan(text, enc, ratio, shortest)
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            return out

        return step

    return map_columns(docs.select(id_col, text_col), make, schema, text_col)


def redact_secrets(docs: DataFrame, path: str, pattern: str, text_col: str = "text", mark: str = "[SECRET]", ratio: float = 2.2, shortest: int = 20) -> DataFrame:
    """The same rows with secrets in the text replaced by `mark`; a null text
    stays null. All other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = made(lambda: encoding(path, pattern))
        for batch in batches:
            for part in slices(batch, text_col):
                at = part.schema.get_field_index(text_col)
                clean = [t if t is None else redacted(t, scan(t, enc, ratio, shortest)[1], mark) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))
        del enc
        give_back()

    return bounded_batches(docs).mapInArrow(run, docs.schema)
