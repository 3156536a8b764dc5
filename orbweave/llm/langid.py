"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, which a
forward pass over its bytes gives; a text's is the product over its words.
Single bytes are pieces, so that every word has a segmentation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import distinct_parts, map_columns, portions, resident, texts

#: Labelled texts of each language that the probabilities are fitted on, about.
SAMPLE_PER_LANGUAGE = 1000
#: Added to each piece's count.
SMOOTHING = 0.1
#: Words of up to so many bytes are scored together.
WIDE = 64
#: A worker remembers the scores of so many words at most.
REMEMBERED, REMEMBERED_BYTES = 150_000, 32_000_000
#: Texts are scored in parts of about so many characters, since a part takes about 30 times as many bytes.
SCORED_CHARS = 500_000
#: The forward passes over words that are scored together take about so many bytes.
FORWARD_BYTES = 4_000_000
#: Nats a byte that are added in the forward pass, to stay within the range of doubles.
_LIFT = 6.0


class Pieces:
    """The vocabulary as a trie over bytes; a word's leading space stands for the word start mark."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.index: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.of_id = np.full(self.model.vocab_size(), -1, np.int64)
        for i in range(self.model.vocab_size()):
            if self.model.is_byte(i):
                self.of_id[i] = int(self.model.id_to_piece(i)[1:-1], 16)
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                piece = self.model.id_to_piece(i).replace("▁", " ")
                if " " not in piece[1:]:
                    self.of_id[i] = self.index.setdefault(piece.encode(), len(self.index))
        nodes: dict[bytes, int] = {b"": 0}
        for piece in self.index:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        self.piece = np.full(len(nodes), -1, np.int32)
        children: list[list[int]] = [[] for _ in nodes]  # of each node: the bytes that go on from it
        for prefix, node in nodes.items():
            if prefix:
                children[nodes[prefix[:-1]]].append(prefix[-1])
                self.piece[node] = self.index.get(prefix, -1)
        self._lay_out(nodes, children)

    def _lay_out(self, nodes: dict[bytes, int], children: list[list[int]]) -> None:
        """The steps from node to node as one array, in which the nodes' rows of 256 are laid over each
        other so that no two steps share a place: a node's row starts at `base`, `owner` names the node of a step."""
        self.base = np.zeros(len(nodes), np.int32)
        taken, low = bytearray(512), 0
        for node in sorted(range(len(nodes)), key=lambda n: -len(children[n])):
            own = sorted(children[node])
            if not own:
                break
            first, tries = taken.find(0, max(low, own[0])), 0
            while any([taken[first - own[0] + b] for b in own]):
                first, tries = taken.find(0, first + 1), tries + 1
            if tries > 20:
                low = first  # gaps before it are left alone
            for b in own:
                taken[first - own[0] + b] = 1
            self.base[node] = first - own[0]
            taken.extend(bytes(max(0, first + 768 - len(taken))))
        self.next, self.owner = np.full(len(taken), -1, np.int32), np.full(len(taken), -1, np.int32)
        for prefix, node in nodes.items():
            if prefix:
                before = nodes[prefix[:-1]]
                at = self.base[before] + prefix[-1]
                self.next[at], self.owner[at] = node, before

    def counts(self, batch: list[str]) -> np.ndarray:
        out = np.zeros(len(self.index), np.int64)
        for text in batch:
            found = self.of_id[np.array(self.model.encode(text), np.int64)]
            out += np.bincount(found[found >= 0], minlength=len(self.index))
        return out


def pieces(path: str) -> Pieces:
    return resident(("pieces", path), lambda: Pieces(path))


@dataclass
class Model:
    """Languages, their piece probabilities (pieces x languages) and log priors."""

    languages: list[str]
    probability: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, path: str, lang_col: str, text_col: str, id_col: str, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a sample of about `per_language` rows of each language, drawn by a
    hash of the id; rows with a null text or language take no part."""
    labelled = docs.select(id_col, text_col, F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy("lang").count()
    languages = {r["lang"]: r["count"] for r in sizes.orderBy("lang").collect()}
    order = sorted(languages)
    if not order:
        return Model([], np.zeros((0, 0)), np.zeros(0))
    share = F.lit(0.0)
    for lang, n in languages.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    drawn = labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(10)), F.lit(1 << 20)) < share * (1 << 20))

    def make():
        vocab = pieces(path)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, text_col), strict=True):
                by.setdefault(lang, []).append(text)
            out: dict[str, list] = {"lang": [], "piece": [], "n": []}
            for lang, own in by.items():
                counts = vocab.counts(own)
                for p in np.flatnonzero(counts).tolist():
                    for c, v in zip(out, (lang, p, int(counts[p])), strict=True):
                        out[c].append(v)
            return out

        return step

    # At most one row for each piece of the vocabulary and language.
    counted = map_columns(drawn, make, "lang string, piece int, n long", text_col).groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(pieces(path).index), len(order)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(order)}
    np.add.at(table, (counted["piece"].to_numpy(np.int64), counted["lang"].map(place).to_numpy(np.int64)), counted["n"].to_numpy(float))
    rows = np.array([languages[lang] for lang in order], float)
    return Model(order, table / table.sum(0), np.log(rows / rows.sum()))


class Scorer:
    """Log probabilities of words under each language, remembered in part."""

    def __init__(self, vocab: Pieces, model: Model):
        self.vocab, self.model, k = vocab, model, len(model.languages)
        length = np.zeros(len(vocab.index))
        for piece, i in vocab.index.items():
            length[i] = len(piece)
        self.lifted = model.probability * np.exp(_LIFT * length)[:, None]
        self.known: dict[str, int] = {}
        self.scores = np.zeros((min(REMEMBERED, REMEMBERED_BYTES // (8 * max(k, 1))), k))

    def short(self, words: list[bytes], width: int) -> np.ndarray:
        """Forward passes over words of at most `width` bytes, side by side."""
        base, owner, step, piece, lifted = self.vocab.base, self.vocab.owner, self.vocab.next, self.vocab.piece, self.lifted
        n, lengths = len(words), np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        forward = np.zeros((width + 1, n, lifted.shape[1]))
        forward[0] = 1
        for start in range(width):
            rows = np.flatnonzero(lengths > start)
            node = np.zeros(len(rows), np.int32)
            for end in range(start, width):
                at = base[node] + flat[rows, end]
                on = (owner[at] == node) & (lengths[rows] > end)
                rows, node = rows[on], step[at[on]]
                if not len(rows):
                    break
                found = piece[node]
                whole = found >= 0
                at = rows[whole]
                forward[end + 1, at] += forward[start, at] * lifted[found[whole]]
        return np.log(forward[lengths, np.arange(n)]) - _LIFT * lengths[:, None]

    def long(self, word: bytes) -> np.ndarray:
        """A forward pass over one word, scaled at each byte."""
        base, owner, step, piece, lifted = self.vocab.base, self.vocab.owner, self.vocab.next, self.vocab.piece, self.lifted
        pending: dict[int, np.ndarray] = {0: np.ones(lifted.shape[1])}
        scale = np.zeros(lifted.shape[1])
        for start in range(len(word)):
            here = pending.pop(start)
            scale += np.log(here)
            pending = {k: v / here for k, v in pending.items()}
            node = 0
            for end in range(start, len(word)):
                at = base[node] + word[end]
                node = step[at] if owner[at] == node else -1
                if node < 0:
                    break
                if piece[node] >= 0:
                    pending[end + 1] = pending.get(end + 1, 0) + lifted[piece[node]]
        return scale + np.log(pending[len(word)]) - _LIFT * len(word)

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.lifted.shape[1]))
        by: dict[int, list[int]] = {}
        raw = [b" " + w.encode() for w in words]
        for i, w in enumerate(raw):
            if len(w) > WIDE:
                out[i] = self.long(w)
            else:
                by.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
        for width, places in by.items():
            each = max(1, FORWARD_BYTES // (8 * (width + 1) * max(1, out.shape[1])))
            for start in range(0, len(places), each):
                part = places[start : start + each]
                out[part] = self.short([raw[i] for i in part], width)
        return out

    def totals(self, batch: list[str]) -> np.ndarray:
        """Log probabilities of whole texts, without the prior."""
        return np.concatenate([self._totals(part) for part in portions(batch, SCORED_CHARS)])

    def _totals(self, batch: list[str]) -> np.ndarray:
        bounds, at, words = distinct_parts(pc.utf8_split_whitespace(pa.array(batch, pa.large_string())))
        known, n = self.known, len(self.known)
        fresh = [w for w in words if w not in known]
        got = self.words(fresh)
        kept = min(len(fresh), len(self.scores) - n)
        self.scores[n : n + kept] = got[:kept]
        known.update(zip(fresh[:kept], range(n, n + kept), strict=True))
        rest = dict(zip(fresh[kept:], range(kept, len(fresh)), strict=True))
        places = np.array([known.get(w, -1) for w in words], np.int64)
        scores = self.scores[places]
        if rest:
            scores[places < 0] = got[[rest[w] for w in words if w in rest]]
        scores[[i for i, w in enumerate(words) if not w]] = 0  # beside leading or trailing white space
        sums = np.zeros((len(batch), got.shape[1]))
        some = np.diff(bounds) > 0
        if some.any():
            sums[some] = np.add.reduceat(scores[at], bounds[:-1][some])
        return sums


def predict(docs: DataFrame, model: Model, path: str, text_col: str = "text") -> DataFrame:
    """All columns, and lang_pred and lang_score after them: the language of
    greatest posterior probability and that probability. `und` and 0 where the
    text is null or has no letter, or where no language was learned. Columns of
    those names are replaced; nulls in others stay as they are, and repeated rows
    and an empty table give as many rows."""
    docs = docs.drop("lang_pred", "lang_score")
    names = docs.columns

    def make():
        scorer = Scorer(pieces(path), model) if model.languages else None

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            own = texts(batch, text_col)
            pred, score = ["und"] * len(own), [0.0] * len(own)
            lettered = [i for i, t in enumerate(own) if any(map(str.isalpha, t))]
            if scorer is not None and lettered:
                total = scorer.totals([own[i] for i in lettered]) + model.prior
                best = total.argmax(1)
                posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i, b, p in zip(lettered, best.tolist(), posterior.tolist(), strict=True):
                    pred[i], score[i] = model.languages[b], p
            return {c: batch.column(c) for c in names} | {"lang_pred": pred, "lang_score": score}

        return step

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_columns(docs, make, f"{out}, lang_pred string, lang_score double", text_col)


def held_out(id_col: str = "doc_id") -> F.col:
    """Whether the CRC-32 of the id as text leaves 1 when divided by three; such rows teach nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Languages of whole texts, learned from the rows that aren't held out.

    One row for each input row, repeated ones too: the id column, held_out,
    lang_pred and score (see predict). A null id isn't held out.
    """
    model = fit(docs.where(~held_out(id_col)), path, lang_col, text_col, id_col)
    asked = docs.select(id_col, text_col, held_out(id_col).alias("held_out"))
    return predict(asked, model, path, text_col).select(id_col, "held_out", "lang_pred", F.col("lang_score").alias("score"))
