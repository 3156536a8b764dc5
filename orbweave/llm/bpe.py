"""Byte-level BPE by a segment tree over byte positions.

The leaves of a piece's tree are its byte positions; leaf i holds the rank of
the pair that starts there, and inner nodes hold minima, so the root names the
leftmost pair of lowest rank. A merge closes one leaf and changes those of the
two live neighbours: three point updates of logarithmic cost. Short pieces are
merged many at a time, one numpy column a piece, the levels above the changed
leaves computed for all at once; long ones one by one.
"""

from __future__ import annotations

import array
import base64
import hashlib
import itertools
import re
import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from orbweave.llm.common import gather, map_columns, portions, resident, texts

#: Pieces of up to so many bytes are merged together.
WIDE = 64
#: Texts are encoded in parts of about so many characters, since a part takes up to 40 times as many bytes.
ENCODED_CHARS = 1_000_000
#: So many new chunks are looked at together.
TOGETHER = 50_000
#: Of pieces that are merged together, padded to one width, about so many bytes: each takes about 50 bytes of memory.
MERGED_BYTES = 160_000
#: A worker remembers the ids of chunks, up to so many bytes of both and _EACH for each.
REMEMBERED_BYTES, _EACH = 40_000_000, 150
# Above all ranks; with a position of 7 bits beside it, it fits into 32.
_NONE = (1 << 24) - 1
#: Marks that are neither letters nor numbers nor white space.
_MARKS = string.punctuation


#: Before a space that follows something else than white space.
_CUT = re.compile(r"(?<=\S)(?= )")


# Fixed value: the pattern by which a text can be cut before such a space, since no piece reaches over it.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _spaced(chunk: str) -> str:
    """The chunk with the space before it; one that is marked by a space has none."""
    return chunk[1:] if chunk[:1] == " " else " " + chunk


def _plain_lines(chunk: str) -> list[str]:
    """Letters and marks in turn, of which all lines of a chunk are, with the line's end after its marks; else nothing.
    A line but the first has no space before it."""
    if "\n" not in chunk:
        return []
    first, *lines = chunk.split("\n")
    out = []
    for line in (first, *(" " + x for x in lines)):
        word = line.rstrip(_MARKS)
        if not (word.isalpha() or word[:1] == " " and word[1:].isalpha()):
            return []
        out += [word, line[len(word) :] + "\n"]
    out[-1] = out[-1][:-1]
    return out


class Vocabulary:
    """A rank file and its merges; `pattern` splits text into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern, self.cuttable = regex.compile(pattern), pattern == CUTTABLE
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes = np.array([len(t) for t in self.tokens], np.int64)
        self.token_flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_starts = np.cumsum(self.token_bytes) - self.token_bytes
        self._fill_table()
        pairs = np.arange(1 << 16)
        self.byte_pairs = self.pair_ranks(self.byte_ids[pairs >> 8], self.byte_ids[pairs & 255])
        # Remembered chunks by number, in order: where each one's ids end in `flat`, whether a text
        # with it is cut otherwise, in how many parts it was found.
        self.place: dict[str, int] = defaultdict(itertools.count().__next__)
        self.flat, self.ends = bytearray(), array.array("q", [0])
        self.odd, self.found = bytearray(), bytearray()
        self.room = REMEMBERED_BYTES

    def _fill_table(self) -> None:
        """An open hash table of the pairs, for lookups of many pairs at once."""
        pairs, merged = array.array("q"), array.array("q")
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        keys, ranks = np.array(pairs, np.int64), np.array(merged, np.int32)
        self.bits = max(12, (4 * len(keys)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, _NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slot_key[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], ranks[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, ranks, at = keys[rest], ranks[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); _NONE where they don't merge or an id is negative."""
        keys = (a.astype(np.int64) << 32) | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], np.int32(_NONE))
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most `width` bytes (a power of two), all merged side by side: a piece is a column,
        a node of the trees a row. In each round one pair of each piece is merged, then the trees' levels follow."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        flat = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width).T
        place = np.arange(width, dtype=np.int32)[:, None]
        # One row more than positions: `width` is "no neighbour", whose id is -1 and whose leaf isn't looked at.
        ids = np.full((width + 1, n), -1, np.int32)
        ids[:width] = np.where(place < lengths, self.byte_ids[flat], -1)
        after = np.repeat(np.arange(1, width + 2), n).reshape(-1, n)
        before = np.repeat(np.arange(-1, width), n).reshape(-1, n)
        after[width], before[0] = width, width
        tree = np.full((2 * width + 1, n), _NONE << 7, np.int32)
        pairs = self.byte_pairs[flat[:-1].astype(np.int32) << 8 | flat[1:]]
        tree[width : 2 * width - 1] = np.where(place[1:] < lengths, pairs, _NONE) << 7 | place[:-1]
        tree[2 * width - 1] = _NONE << 7
        ids_, after_, before_, tree_ = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        while True:
            level = width
            while level > 1:
                np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2], out=tree[level // 2 : level])
                level //= 2
            own = np.flatnonzero(tree[1] < _NONE << 7)
            if not len(own):
                break
            best = tree[1, own]
            i, merged = (best & 127).astype(np.int64), best >> 7
            at_i = i * n + own
            j = after_[at_i]
            at_j = j * n + own
            k, h = after_[at_j], before_[at_i]
            at_k, at_h = k * n + own, h * n + own
            ids_[at_i], ids_[at_j] = merged, -1
            after_[at_i] = k
            before_[at_k] = i
            ranks = self.pair_ranks(np.concatenate([merged, ids_[at_h]]), np.concatenate([ids_[at_k], merged])) << 7
            leaves = width * n
            tree_[leaves + at_j] = _NONE << 7
            tree_[leaves + at_i] = ranks[: len(own)] | i
            tree_[leaves + at_h] = ranks[len(own) :] | h
        rows = np.ascontiguousarray(ids[:width].T)
        kept = rows >= 0
        flat_ids = rows[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length, in about 50 bytes a byte. A node of the tree is rank and position in one number."""
        n = len(piece)
        width = 1 << max(0, (n - 1).bit_length())
        start = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rows = np.full(2 * width, _NONE << 22, np.int64) if n < 1 << 22 else np.full(2 * width, np.int64(1 << 62))
        shift = 22 if n < 1 << 22 else 40
        first = self.pair_ranks(start[:-1], start[1:])
        rows[width : width + n - 1] = np.where(first < _NONE, first.astype(np.int64) << shift | np.arange(n - 1), rows[0])
        level = width
        while level > 1:
            rows[level // 2 : level] = np.minimum(rows[level : 2 * level : 2], rows[level + 1 : 2 * level : 2])
            level //= 2
        tree, none, low = array.array("q", rows.tobytes()), int(rows[0]), (1 << shift) - 1
        ids, after, before = (array.array("i", x.astype(np.int32).tobytes()) for x in (start, np.arange(1, n + 1), np.arange(-1, n - 1)))
        get, tokens = self.ranks.get, self.tokens

        def put(i: int, rank: int | None) -> None:
            node = width + i
            value = tree[node] = none if rank is None else rank << shift | i
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                value = value if value < other else other
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            rank, i = tree[1] >> shift, tree[1] & low
            j = after[i]
            k, h = after[j], before[i]
            ids[i], ids[j], after[i] = rank, -1, k
            put(j, None)
            if k < n:
                before[k] = i
            put(i, get(tokens[rank] + tokens[ids[k]]) if k < n else None)
            if h >= 0:
                put(h, get(tokens[ids[h]] + tokens[rank]))
        out = np.frombuffer(ids, np.int32)
        return out[out >= 0].astype("<u4")

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        short: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[at] = whole.to_bytes(4, "little")
            elif len(piece) > WIDE:
                out[at] = self.merge_long(piece).tobytes()
            elif piece:
                short.setdefault(1 << (len(piece) - 1).bit_length(), []).append(at)
        for width, places in short.items():
            step = max(1, MERGED_BYTES // width)
            for start in range(0, len(places), step):
                part = places[start : start + step]
                for at, ids in zip(part, self.merge_short([pieces[i] for i in part], width), strict=True):
                    out[at] = ids
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers.

        A space after anything but white space always starts a new piece, and
        what follows it doesn't depend on what was before. So texts are cut at
        their spaces, and the ids of a chunk with its space are remembered. Texts
        with a space after white space are cut at the other spaces alone. By another
        pattern than CUTTABLE texts are encoded whole.
        """
        if not self.cuttable:
            return [self._encode_texts([t])[0] for t in batch]
        return [ids for part in portions(batch, ENCODED_CHARS) for ids in self._encode_part(part)]

    def _encode_part(self, batch: list[str]) -> list[bytes]:
        known, number, each = len(self.odd), self.place.__getitem__, []
        for text in batch:
            chunks = text.split(" ")
            chunks[0] = " " + chunks[0]  # a text's first chunk has no space before it; no chunk has one, so one marks it
            each.append(np.fromiter(map(number, chunks), np.int32, len(chunks)))
        new = list(itertools.islice(reversed(self.place), len(self.place) - known))[::-1]
        for start in range(0, len(new), TOGETHER):
            self._encode_chunks(new[start : start + TOGETHER], known)
        ends, odd, found = np.frombuffer(self.ends, np.int64), np.frombuffer(self.odd, bool), np.frombuffer(self.found, np.uint8)
        flat, starts, sizes, out = np.frombuffer(self.flat, "<u4"), ends[:-1], np.diff(ends), []
        here = np.zeros(len(found), bool)
        for text, at in zip(batch, each, strict=True):
            here[at] = True
            out.append(b"".join(self._encode_texts(_CUT.split(text))) if odd[at].any() else gather(flat, starts, sizes, at)[0].tobytes())
        found += here & (found < 255)
        del flat, starts, ends, odd, found  # of what grows with the next part
        if self.room < 0:
            self._forget()
        return out

    def _encode_chunks(self, chunks: list[str], known: int) -> None:
        """Ids of new chunks, each with its space. Letters with or without marks after them, as most are, alone
        or in lines, are a piece or two a line by CUTTABLE without a search for them."""
        heads = [c.rstrip(_MARKS) for c in chunks]
        plain = [h.isalpha() for h in heads]
        tails = ["" if h is c else c[len(h) :] for c, h in zip(chunks, heads, strict=True)]
        lines = {c: own for c, p in zip(chunks, plain, strict=True) if not p and (own := _plain_lines(c))}
        words = {h: b"" for h, p in zip(heads, plain, strict=True) if p} | {w: b"" for own in lines.values() for w in own[::2]}
        marks = {t: b"" for t, p in zip(tails, plain, strict=True) if p} | {m: b"" for own in lines.values() for m in own[1::2]}
        rest = [c for c, p in zip(chunks, plain, strict=True) if not p and c not in lines]
        at, ends, flat = [self.place.get(w, known) for w in words], self.ends, self.flat
        fresh = [w for w, i in zip(words, at, strict=True) if i >= known]
        for w, i in zip(words, at, strict=True):
            if i < known:
                words[w] = bytes(flat[4 * ends[i] : 4 * ends[i + 1]])
        words.update(zip(fresh, self.encode_pieces([_spaced(w).encode() for w in fresh]), strict=True))
        marks.update(zip(marks, self._encode_texts(list(marks)), strict=True))
        other = dict(zip(rest, self._encode_texts([_spaced(c) for c in rest]), strict=True))
        other |= {c: b"".join([(marks if i % 2 else words)[x] for i, x in enumerate(own)]) for c, own in lines.items()}
        ids = [words[h] + marks[t] if p else other[c] for c, h, t, p in zip(chunks, heads, tails, plain, strict=True)]
        ends.extend((ends[-1] + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)).tolist())
        flat += b"".join(ids)
        self.odd += bytes([c == "" or c[-1].isspace() and c != " " for c in chunks])
        self.found += bytes(len(chunks))
        self.room -= sum(map(len, chunks)) + sum(map(len, ids)) + _EACH * len(chunks)

    def _forget(self) -> None:
        """Keep the chunks that were found in the most parts, two at least, up to half of what may be remembered."""
        found, ends = np.frombuffer(self.found, np.uint8), np.frombuffer(self.ends, np.int64)
        sizes = np.diff(ends)
        cost = np.fromiter(map(len, self.place), np.int64, len(found)) + 4 * sizes + _EACH
        total = np.cumsum(np.bincount(found, cost, 256)[::-1])[::-1]  # of those found in so many or more
        kept = np.flatnonzero(found >= max(2, 256 - int((total <= REMEMBERED_BYTES // 2).sum())))
        flat, stops = gather(np.frombuffer(self.flat, "<u4"), ends[:-1], sizes, kept)
        mask = np.zeros(len(found), bool)
        mask[kept] = True
        names = list(itertools.compress(self.place, mask.tolist()))
        self.place.clear()
        self.place = defaultdict(itertools.count(len(names)).__next__, zip(names, range(len(names)), strict=True))
        self.room = REMEMBERED_BYTES - int(cost[kept].sum())
        self.odd, self.found = bytearray(np.frombuffer(self.odd, np.uint8)[kept]), bytearray(found[kept] // 2)
        self.flat, self.ends = bytearray(flat), array.array("q", [0, *stops.tolist()])

    def _encode_texts(self, parts: list[str]) -> list[bytes]:
        split = [[p.encode() for p in self.pattern.findall(c)] for c in parts]
        pieces = list({p for ps in split for p in ps})
        ids = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        return [b"".join([ids[p] for p in ps]) for ps in split]

    def decode(self, ids: bytes) -> bytes:
        return gather(self.token_flat, self.token_starts, self.token_bytes, np.frombuffer(ids, "<u4"))[0].tobytes()


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary for each Python worker."""
    return resident(("vocabulary", path, pattern), lambda: Vocabulary(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Encode whole texts and decode them again.

    Returns one row for each input row, repeated ones too: the id column,
    n_tokens, ids (binary, little-endian unsigned 32-bit; left out unless
    `ids`), ids_sha256 and decoded_sha256. A null text counts as empty and has
    no ids; a null id stays null. `path` is a rank file that every executor can
    read; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids

    def make():
        vocab = vocabulary(path, pattern)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            encoded = vocab.encode(texts(batch, text_col))
            out = {
                id_col: batch.column(id_col),
                "n_tokens": [len(x) // 4 for x in encoded],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in encoded],
                "decoded_sha256": [hashlib.sha256(vocab.decode(x)).hexdigest() for x in encoded],
            }
            return out | ({"ids": encoded} if ids else {})

        return step

    return map_columns(docs.select(id_col, text_col), make, schema, text_col)
