"""Best-fit decreasing packing of token sequences.

Lengths go from long to short; each piece goes to the open bin with the least
room that holds it, which a segment tree over remaining capacities finds in
logarithmic time. Pieces of one length are alike, so the driver packs the
histogram of lengths (at most `capacity` entries, however many documents there
are) and places runs of equal pieces into runs of equal bins; the pieces then
look up their own places by their rank among those of their length.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orbweave.llm.bpe import Vocabulary, vocabulary
from orbweave.llm.common import checkpointed, map_columns, texts


class Room:
    """Segment tree over capacities: how many intervals of bins have that much room."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, n: int) -> None:
        node = self.width + room
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least `need` that some bin has."""
        node = self.width + need
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, offset), by length and rank: pieces of
    that length from that rank on go to consecutive bins, each at that offset."""
    room, open_bins = Room(capacity), {r: [] for r in range(capacity + 1)}
    runs, bins = [], 0

    def put(interval: tuple[int, int], left: int) -> None:
        if interval[1] and left:
            open_bins[left].append(interval)
            room.add(left, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            space = room.tightest(length)
            if space is None:
                each = capacity // length
                first, n, space = bins, -(-left // each), capacity
                bins += n
            else:
                first, n = open_bins[space].pop()
                room.add(space, -1)
                each = space // length
            # A bin that took one such piece is the tightest for the next, as long as it holds it.
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each
            for layer in range(each):
                here = full + (layer < rest)
                if here:
                    runs.append((length, rank, first, capacity - space + layer * length))
                    rank += here
                    left -= here
            put((first, full), space - each * length)
            if rest:
                put((first + full, 1), space - rest * length)
            put((first + full + (rest > 0), n - full - (rest > 0)), space)
    return np.array(sorted(runs), np.int64).reshape(-1, 4)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes what doesn't fill a sequence."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def added_tokens(path: str) -> dict[str, int]:
    """The tokens beside the merges of a tokenizer's json, which it finds in a text before anything else."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    added = whole.get("added_tokens") or []
    for t in added:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or (t["normalized"] and whole.get("normalizer")):
            raise ValueError(f"the added token {t['content']!r} isn't matched as it stands")
    return {t["content"]: t["id"] for t in added if t["content"]}


def encode_with_added(vocab: Vocabulary, batch: list[str], added: dict[str, int]) -> list[bytes]:
    """Ids of each text: the leftmost, then longest added tokens as they stand, what is between them by the merges."""
    if not any(t in text for text in batch for t in added):
        return vocab.encode(batch)
    found = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    split = [found.split(text) for text in batch]  # every other part is an added token
    between = iter(vocab.encode([part for parts in split for part in parts[::2]]))
    return [b"".join(added[part].to_bytes(4, "little") if i % 2 else next(between) for i, part in enumerate(parts)) for parts in split]


def tokenized_pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int, id_col: str, text_col: str, tokens: bool, json_path: str | None = None) -> DataFrame:
    """Pieces of each document, with their partition and their rank there among those of their length."""
    added = added_tokens(json_path) if json_path else {}
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * tokens
    ends = end_id.to_bytes(4, "little")

    def make():
        vocab, part, seen = vocabulary(path, pattern), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in (id_col, "piece", "start", "length", "ids_crc32", "part", "nth", "ids")}
            for doc, ids in zip(batch.column(id_col).to_pylist(), encode_with_added(vocab, texts(batch, text_col), added), strict=True):
                ids += ends
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(out, (doc, piece, start, length, zlib.crc32(own), part, int(seen[length]), own), strict=True):
                        out[c].append(v)
                    seen[length] += 1
            return out

        return step

    return map_columns(docs.select(id_col, text_col), make, schema, text_col)


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False, json_path: str | None = None) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens.

    Each input row, repeated ones too, is its text's ids and then `end_id`; a
    null or empty text is `end_id` alone, a null id stays null. `path` is a rank
    file; the added tokens of the tokenizer's json at `json_path`, if given, are
    found in the texts and get their own ids. Only documents
    longer than a sequence are cut. Returns one row for each piece: the id
    column, piece, start, length, ids_crc32, sequence_id, offset (gapless within
    a sequence), and with `tokens` the piece's ids (binary, little-endian
    unsigned 32-bit). An empty table gives no rows; other columns are ignored.
    """
    pieces = checkpointed(tokenized_pieces(docs, path, pattern, capacity, end_id, id_col, text_col, tokens, json_path))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # At most `capacity` rows.
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit_runs(lengths, capacity)
    key = (runs[:, 0] << 44) | runs[:, 1]

    ranked = pieces.join(offsets, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before")
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * tokens]
    fields = [ranked.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def place(batches):
        for batch in batches:
            length, nth = (np.asarray(batch.column(c)) for c in ("length", "nth"))
            run = np.searchsorted(key, (length << 44) | nth, side="right") - 1
            columns = [batch.column(c) for c in names] + [pa.array(runs[run, 2] + nth - runs[run, 1]), pa.array(runs[run, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, T.StructType(fields))
