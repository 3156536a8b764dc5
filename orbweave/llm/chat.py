"""Conversations as training texts: rendered by a template whose control strings can't occur in
texts, encoded once with offsets, and masked where an assistant speaks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from orbweave.llm.common import map_sorted, map_stream, resident

#: Turns are rendered and encoded in parts of about so many characters, cut between turns: a
#: conversation is one part unless it is longer. Markers begin and end each turn and are
#: tokens of their own, so a cut changes no token.
PART_CHARS = 4_000_000


@dataclass(frozen=True)
class Template:
    """A turn is start, role, message, text, end. `others` are strings that are control strings
    elsewhere and are kept out of texts too. Each control string begins with a character
    that is nowhere else in one, and none holds a backslash."""

    start: str = "<|start|>"
    message: str = "<|message|>"
    end: str = "<|end|>"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    loss_role: str = "assistant"

    def __post_init__(self) -> None:
        firsts = {c[0] for c in self.controls}
        if any(x in firsts or x == "\\" for c in self.controls for x in c[1:]) or "\\" in firsts:
            raise ValueError("a control string's first character is nowhere else in one, and none holds a backslash")

    @property
    def markers(self) -> tuple[str, ...]:
        return self.start, self.message, self.end

    @property
    def controls(self) -> tuple[str, ...]:
        return (*self.markers, *self.others)

    @cached_property
    def _rest(self) -> str:
        return r"(?=\\*(?:" + "|".join(re.escape(c[1:]) for c in self.controls) + "))"

    @cached_property
    def _plain(self) -> re.Pattern:
        return re.compile("([" + re.escape("".join(sorted({c[0] for c in self.controls}))) + "])" + self._rest)

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile("([" + re.escape("".join(sorted({c[0] for c in self.controls}))) + r"])\\" + self._rest)

    def escape(self, text: str) -> str:
        """A backslash more behind the first character of each control string, however many are there already."""
        return self._plain.sub(r"\1\\", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text of turns (role, text), and where texts that are learned from stand in it."""
        out, at, spans = [], 0, []
        for role, text in turns:
            head = f"{self.start}{self.escape(role)}{self.message}"
            body = self.escape(text)
            if role == self.loss_role:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(out), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a rendered text."""
        turns = []
        for turn in formatted.split(self.start)[1:]:
            role, _, body = turn.partition(self.message)
            turns.append((self.unescape(role), self.unescape(body.removesuffix(self.end))))
        return turns


def tokenizer(path: str, template: Template) -> Tokenizer:
    """The tokenizer of a json, with the template's markers as added tokens."""
    own = Tokenizer.from_file(path)
    own.add_special_tokens([AddedToken(m, normalized=False) for m in template.markers])
    return own


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (sorted starts and ends) reach into one of the sorted spans: two binary searches a span."""
    mask = np.zeros(len(starts), bool)
    if spans and len(starts):
        a, b = np.array(spans, np.int64).T
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        steps = np.zeros(len(starts) + 1, np.int64)
        some = (b > a) & (last > first)
        np.add.at(steps, first[some], 1)
        np.add.at(steps, last[some], -1)
        mask = np.cumsum(steps[:-1]) > 0
    return mask


def runs(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches of text under runs of masked tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    for first, last in zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True):
        yield int(starts[first]), int(ends[last])


def format_conversations(
    rows: DataFrame, path: str, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS
) -> DataFrame:
    """Conversations, as (id, part, n_turns, formatted, ids, starts, ends, loss): the rendered
    text, its token ids with their offsets in code points, and which of them are learned from.

    One row a conversation, with part 0, unless it has more than `part_chars` characters; then
    its turns go on in parts 1, 2, ... Turns are in order of turn (null first), then role and
    text; repeated rows are turns of their own. A null role or text is the empty one; an empty
    text has no token to learn from. Rows with a null id are one conversation. Other columns
    are left out; no rows give no rows. A conversation's rows meet in one task, which holds a
    part of it at a time, and one turn at least.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    own = rows.select(F.col(id_col).alias("_id"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def make():
        known = resident(("chat", path, template), lambda: tokenizer(path, template))
        held: dict = {"id": None, "part": 0, "turns": [], "chars": 0}

        def flush(out: dict[str, list]) -> None:
            formatted, spans = template.render(held["turns"])
            got = known.encode(formatted, add_special_tokens=False)
            offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
            starts, ends = offsets[:, 0], offsets[:, 1]
            for c, v in zip(out, (held["id"], held["part"], len(held["turns"]), formatted, got.ids, starts, ends, masked(starts, ends, spans)), strict=True):
                out[c].append(v)
            held.update(part=held["part"] + 1, turns=[], chars=0)

        def step(batch: pa.RecordBatch | None) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in ("_id", "part", "n_turns", "formatted", "ids", "starts", "ends", "loss")}
            if batch is None:
                if held["turns"]:
                    flush(out)
                return out
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_role", "_text")), strict=True):
                if held["turns"] and (conv != held["id"] or held["chars"] > part_chars):
                    flush(out)
                if conv != held["id"]:
                    held.update(id=conv, part=0)
                held["turns"].append((role, text))
                held["chars"] += len(role) + len(text)
            return out

        return step

    schema = f"_id {kind}, part int, n_turns long, formatted string, ids array<int>, starts array<long>, ends array<long>, loss array<boolean>"
    order = [F.col("_turn").asc_nulls_first(), "_role", "_text"]
    return map_sorted(own, ["_id"], order, make, schema, "_text").withColumnRenamed("_id", id_col)


def read_back(formatted: DataFrame, template: Template = Template(), id_col: str = "conv_id") -> DataFrame:
    """What formatted conversations hold, read from their texts, offsets and masks alone: one row
    a conversation with n_turns, turns_sha256 (role, line feed, text, line feed of each turn),
    loss_chars and loss_sha256 (the text under the mask, unescaped) and formatted_chars.
    A conversation's parts must follow each other in one partition, as they do after
    format_conversations; the digests go on from part to part."""
    kind = formatted.schema[id_col].dataType.simpleString()
    own = formatted.select(F.col(id_col).alias("_id"), "part", "formatted", "starts", "ends", "loss")
    columns = ("_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def make():
        held: dict = {}

        def flush(out: dict[str, list]) -> None:
            if held:
                for c, v in zip(columns, (held["id"], held["turns"], held["all"].hexdigest(), held["chars"], held["learned"].hexdigest(), held["size"]), strict=True):
                    out[c].append(v)
                held.clear()

        def step(batch: pa.RecordBatch | None) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in columns}
            if batch is None:
                flush(out)
                return out
            lists = {c: batch.column(c) for c in ("starts", "ends", "loss")}
            for i, (conv, part, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_id", "part", "formatted")), strict=True)):
                if part == 0:
                    flush(out)
                    held.update(id=conv, turns=0, all=hashlib.sha256(), chars=0, learned=hashlib.sha256(), size=0)
                for role, body in template.parse(text):
                    held["turns"] += 1
                    held["all"].update(f"{role}\n{body}\n".encode())
                starts, ends, loss = (lists[c][i].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))
                for a, b in runs(starts, ends, loss):
                    learned = template.unescape(text[a:b])
                    held["chars"] += len(learned)
                    held["learned"].update(learned.encode())
                held["size"] += len(text)
            return out

        return step

    schema = f"_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_stream(own, make, schema, "formatted").withColumnRenamed("_id", id_col)
