"""Formatted conversations, their prefix trie and resampling against plain Python; SQL is compared in test_llm_queries."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Regex, pre_tokenizers

from orbweave.llm import chat, resample, trie

BYTE = public_tokenizers.path("byte_bpe_50k.json")
#: With columns whose names the operators use themselves.
SCHEMA = "conv_id long, turn long, role string, text string, part int, _id string, pos int, prefix string, item int"
ODD = [
    (1, None, "user", "before all"), (1, 0, "user", "<|start|>assistant<|message|> no <|end|>"), (1, 1, "assistant", "<\\|end|> [INST] <</s> <|endoftext|>\\"), (1, 2, "assistant", " again"),
    (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", None), (3, 5, "assistant<|end|>", "\n\n x \n"), (3, 4, "", "日本 🙂é"), (3, 6, "assistant", "🙂🙃 é́\0\n"),
    (None, 0, "user", "nobody"), (None, 1, "assistant", "answers"), (4, 0, "assistant", "x" * 50_000), (4, 1, "user", "[\\/INST][/INST]" * 3), (5, 0, "user", "alone"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", 2, "p", 3) for r in rows], SCHEMA).repartition(3)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def conversations(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<[\\|/>sINTend]x", max_size=30))
def test_escapes_reversibly(text):
    template = chat.Template()
    escaped = template.escape(text)
    assert template.unescape(escaped) == text and not any(c in escaped for c in template.controls)


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template(others=("a<b",))
    with pytest.raises(ValueError):
        chat.Template(end="<\\end>")


def test_masks_by_binary_search():
    rng = random.Random(3)
    for _ in range(50):
        cuts = sorted(rng.sample(range(1, 60), 12))
        starts, ends = np.array([0, *cuts]), np.array([*cuts, 60])
        edges = sorted(rng.sample(range(61), 6))
        spans = [(edges[0], edges[1]), (edges[1], edges[1]), (edges[2], edges[3]), (edges[4], edges[5])]
        want = [any(a < e and s < b for a, b in spans if a < b) for s, e in zip(starts, ends, strict=True)]
        assert chat.masked(starts, ends, spans).tolist() == want
    assert not chat.masked(starts, ends, []).any() and chat.masked(np.zeros(0, int), np.zeros(0, int), [(0, 3)]).tolist() == []


@pytest.mark.parametrize("part_chars", [chat.PART_CHARS, 3])
def test_conversations(spark, part_chars):
    """Parts give the same tokens and the same digests as whole conversations."""
    rows, template = ODD, chat.Template()
    known, want = chat.tokenizer(BYTE, template), conversations(ODD)
    out = chat.format_conversations(frame(spark, rows), BYTE, part_chars=part_chars)
    parts = {}
    for r in out.collect():
        parts.setdefault(r["conv_id"], []).append(r)
    assert set(parts) == set(want) and (part_chars == 3) == (max(map(len, parts.values())) > 1)
    for conv, turns in want.items():
        own = sorted(parts[conv], key=lambda r: r["part"])
        whole = "".join(r["formatted"] for r in own)
        assert template.parse(whole) == turns and [i for r in own for i in r["ids"]] == known.encode(whole, add_special_tokens=False).ids
        learned = [template.escape(text) for role, text in turns if role == "assistant" and text]
        assert [r["formatted"][a:b] for r in own for a, b in chat.runs(np.array(r["starts"]), np.array(r["ends"]), np.array(r["loss"], bool))] == learned
        markers = {known.token_to_id(m) for m in template.markers}
        assert not any(flag and i in markers for r in own for i, flag in zip(r["ids"], r["loss"], strict=True))
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    for conv, turns in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        size = sum(len(template.escape(role)) + len(template.escape(t)) + sum(map(len, template.markers)) for role, t in turns)
        assert tuple(got[conv])[1:] == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(learned), sha(learned), size)
    assert chat.read_back(chat.format_conversations(frame(spark, rows).limit(0), BYTE)).count() == 0


def brute_trie(rows):
    own = {c: [(r, t) for r, t in turns] for c, turns in rows.items() if c is not None}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = [*own.get(base, [])[:h], *turns[h:]]
    members, out = {}, []
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        children = [n for n in under if len(n) == len(node) + 1]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in under)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "ENDS_BYTES", 7)
    rng = random.Random(seed)
    rows = [(rng.choice((100, 200, 300)) + c, t if rng.random() < 0.95 else None, rng.choice(("user", "assistant", None)), rng.choice(("a", "bb", "", None, "日本語"))) for c in range(60) for t in range(rng.randint(1, 4))]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())  # no two at one place, whose order is by digest
    rows += [(700 + c, t, "user", "same") for c in range(30) for t in range(3)] + [(None, 0, "user", "nobody"), (900, 0, "user", "x" * 10_000)]
    got = trie.prefix_trie(trie.rebuilt(trie.turns(frame(spark, rows))))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(conversations(rows))


def test_trie_ties_and_nothing(spark):
    """Rows at one place are in order of their digests, so repeated conversations stay the same."""
    rows = [(c, 0, "user", t) for c in (11, 12) for t in (("p", "q") if c == 11 else ("q", "p"))] + [(13, None, None, None), (13, None, None, None)]
    items = trie.turns(frame(spark, rows))
    seen = {}
    for r in items.orderBy("pos").collect():
        seen.setdefault(r["conv_id"], []).append(bytes(r["item"]))
    assert seen[11] == seen[12] and len(seen[13]) == 2
    assert trie.prefix_trie(trie.rebuilt(trie.turns(frame(spark, rows).limit(0)))).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, bench, percent, longest):
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda t: [" ".join(w[i : i + n]) for w in (words(t),) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = np.zeros(10_000), np.zeros(10_000)
    for total, texts in ((s, [x for _, x in docs]), (t, bench)):
        for text in texts:
            for f in runs(text):
                total[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc, text in docs:
        h = int(sha(f"2024:{'' if doc is None else doc}")[:8], 16)
        weight = sum(gain[bucket(f)] for f in runs(text))
        out.append((doc, len(words(text)), len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = [(*r, i) for i, r in enumerate(may[: percent * len(may) // 100], 1)]
    left = may[len(drawn) :] + [r for r in out if r[1] < 20]
    return sorted(drawn + [(*r, None) for r in left], key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resample(spark, longest):
    rng = random.Random(longest)
    some = lambda n: rng.choice((" ", "\n", "-", "  _")).join(rng.choice(("The", "old", "HOUSE", "é1", "日本", "x9", " ", "Ä")) for _ in range(n))
    docs = [(i, some(rng.choice((3, 19, 20, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, "\0\x7f!"), (None, some(30)), (53, "w" * 3000), (54, some(30)), (54, docs_text := some(25)), (54, docs_text)]
    bench = [some(20), None, ""]
    own = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in docs], "doc_id long, text string, score int, _id int, rank string").repartition(3)
    target = spark.createDataFrame([(0, t) for t in bench], "item_id long, text string")
    got = resample.resample(own, target, percent=30, longest=longest)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(docs, bench, 30, longest)
    if longest == 1:
        assert resample.resample(own.limit(0), target).count() == 0
        alone = resample.resample(own, target.limit(0), percent=30).collect()
        assert sorted(map(tuple, alone), key=repr) == brute_resample(docs, [], 30, 1)


def test_long_text_in_parts():
    text = "ab " * 100_000 + "c" * 200_000 + " d"
    assert "".join(p.replace(" ", "") for p in resample.parts(text)) == text.replace(" ", "") and all(len(p) < 300_000 for p in resample.parts(text))


@pytest.mark.parametrize(("longest", "part", "at_once"), [(1, 5, 50), (3, 40, 7), (2, 1 << 16, 1 << 20)])
def test_histograms_in_parts(monkeypatch, longest, part, at_once):
    """Parts and counts in between give what whole texts give."""
    monkeypatch.setattr(resample, "PART_CHARS", part)
    monkeypatch.setattr(resample, "_AT_ONCE", at_once)
    rng = random.Random(part)
    texts = ["", "-", *(" ".join(rng.choice(("a", "bc", "é", "-", "d" * 9)) for _ in range(n)) for n in (1, 2, 30, 300))]
    got = resample.histograms(texts, pre_tokenizers.Split(Regex(resample.WORD), behavior="removed", invert=True), resample.Buckets(97), longest)
    for i, text in enumerate(texts):
        words, count = WORD.findall(text), {}
        for n in range(1, longest + 1):
            for j in range(len(words) - n + 1):
                b = zlib.crc32(" ".join(words[j : j + n]).encode()) % 97
                count[b] = count.get(b, 0) + 1
        assert dict(zip(got["buckets"][i].as_py(), got["counts"][i].as_py(), strict=True)) == count
        assert (got["n_words"][i], got["n_features"][i]) == (len(words), sum(count.values()))
