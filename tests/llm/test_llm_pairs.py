"""Near duplicates, substring dedup and nearest neighbours against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.llm import ann, nearjoin, substrings, words
from orbweave.llm.graph import components
from orbweave.llm.words import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use themselves.
CLASHING = "doc_id long, text string, id long, sig long, n long, lead long, component string, key string, h int, pos string, starts int, v int"


def rows_of(texts):
    return [(i, t, 0, 0, 0, 0, "", "", 0, "", 0, 0) for i, t in texts]


def invented(seed, n, common=12):
    """Texts with near copies at all distances and passages that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    passages, out = [some(common), some(3 * common)], []
    for _ in range(n):
        if out and rng.random() < 0.5:
            base = list(rng.choice(out))
            for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
                if base:
                    at = rng.randrange(len(base))
                    base[at : at + rng.choice((0, 1, 1, 2))] = some(rng.choice((0, 1, 2)))
        else:
            base = some(rng.choice((0, 1, 3, 4, 5, 6, 9, 15, 30, 60, 150)))
        if rng.random() < 0.5:
            at = rng.randrange(len(base) + 1)
            base[at:at] = rng.choice(passages)
        out.append(base)
    return [" ".join(b).replace("w1", "W1") if rng.random() < 0.3 else "\t ".join(b) for b in out]


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("seed", "common"), [(1, 24), (2, 3), (3, 1)])
def test_near_duplicates(spark, seed, common):
    rows = list(enumerate(invented(seed, 260), 100))
    rows += [(900, ""), (901, None), (902, " \n"), (903, "Ünïcode ÄÖ x y z w"), (904, "ünïcode äö x y z w"), (905, "one two"), (906, "ONE  two"), (907, "q " * 30_000)]
    df = spark.createDataFrame(rows_of(rows), CLASHING).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_duplicates(df, common=common).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    for common in (24, 1):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_duplicates(docs, common=common).collect()}
        assert got == want


@pytest.mark.parametrize("far", [False, True])
def test_differences_are_few(spark, monkeypatch, far):
    """Sets of one group stand against about one pivot each, however many segments they share."""
    rng = random.Random(7)
    bases = [[f"{x}{i}" for i in range(120)] for x in ("u", "v")]
    rows = [(i, list(bases[far and i % 2])) for i in range(240)]
    for i, words in rows:
        for _ in range(3 + i % 4):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
    if far:  # what joins the groups
        rows += [(1000 + i, [*bases[0][:60], *(f"y{i}-{j}" for j in range(9)), *bases[1][60:]]) for i in range(12)]
    rows = [(i, " ".join(w)) for i, w in rows]
    made, mapped = [], nearjoin.map_columns

    def counted(df, make, schema, *text):
        out = mapped(df, make, schema, *text)
        if schema.startswith("key long"):
            made.append(out.count())
        return out

    monkeypatch.setattr(nearjoin, "map_columns", counted)
    df = spark.createDataFrame(rows_of(rows), CLASHING)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_duplicates(df, common=2).collect()}
    assert got == brute_components(rows)
    assert 0 < sum(made) < 80 * len(rows)


def colliding():
    """Two texts that differ in one word: a Thue-Morse word of 1,024 letters and its complement, whose
    polynomial hashes modulo 2**64 are equal for any odd multiplier."""
    word = "a"
    for _ in range(10):
        word = word.translate({97: "ab", 98: "ba"})
    one, two = ([*(f"w{i}" for i in range(10)), w, *(f"v{i}" for i in range(12))] for w in (word, word.translate({97: "b", 98: "a"})))
    return [(1, " ".join(one)), (2, " ".join(two)), (3, one[10]), (4, two[10])]


def test_words_that_collide(spark):
    docs = spark.createDataFrame(rows_of(colliding()), CLASHING)
    assert {r["doc_id"]: r["component_id"] for r in nearjoin.near_duplicates(docs).collect()} == {i: i for i in range(1, 5)}
    assert {r["doc_id"]: r["n_removed"] for r in substrings.deduplicate(docs).collect()} == dict.fromkeys(range(1, 5), 0)


def test_word_hashes():
    bounds, (one, two) = word_hashes([b"", b" a  b\n", b"a", b"\t", "é b".encode()])
    assert bounds.tolist() == [0, 0, 2, 3, 3, 5] and one[0] == one[2] and two[0] == two[2] and one[1] == one[4] and len({*one.tolist(), *two.tolist()}) == 6
    assert word_hashes([])[1].shape == (2, 0) == word_hashes([b" "])[1].shape


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "A b c d e f")]
    got = sorted((tuple(r) for r in nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (9, 2, 5)], key=repr)
    assert nearjoin.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 103: 100}


def brute_kept(rows):
    """(n_words, n_removed, sha256) of each id; ids are distinct."""
    first, out = {}, {}
    order = sorted(rows)
    for doc, text in order:
        words = WORD.findall(text or "")
        for i in range(len(words) - 19):
            first.setdefault(tuple(words[i : i + 20]), (doc, i))
    for doc, text in order:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            if first[tuple(words[i : i + 20])] != (doc, i):
                gone[i : i + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "batches"), [(4, 1), (5, 2), (6, 7)])
def test_substrings(spark, seed, batches):
    rng = random.Random(seed)
    texts = invented(seed, 120, common=25)
    texts += [" ".join(["same"] * 45), "a b " * 40, None, "", "x\u00a0y " * 30, "é " * 25, " ".join(rng.choice("ab") for _ in range(9_000))]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame(rows_of(rows), CLASHING).repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.deduplicate(df, batches=batches).collect()}
    assert got == brute_kept(rows)


def test_substrings_index_compacts(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    parts = [[(10 * b + i, " ".join(f"u{rng.random()}" for _ in range(25)) + " " + passage) for i in range(3)] for b in range(7)]
    index = substrings.FingerprintIndex(spark)
    seen, starts = [], {}
    for part in parts:
        df, old = (spark.createDataFrame(x, "doc_id long, text string") for x in (part, seen))
        found = index.add(df, old if seen else None)
        starts |= {r["id"]: sorted(r["starts"]) for r in found.collect()}
        seen += part
    assert len(index.runs) <= substrings.MOST_RUNS
    index.drop()
    ids = [i for part in parts for i, _ in part]
    assert starts == {i: list(range(25, 36)) for i in ids if i != min(ids)}


def test_substrings_edges(spark):
    text = " ".join(f"z{i}" for i in range(22))
    rows = [(None, text), (3, text), (3, text), (8, text)]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == [(3, 0), (3, 0), (8, 22), (None, 0)]
    assert substrings.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_nearest(vectors, queries, k):
    x = {i: np.asarray(v, float) for i, v in vectors.items()}
    out = {}
    for q in queries:
        score = {i: float(v @ x[q] / np.sqrt((v @ v) * (x[q] @ x[q]))) for i, v in x.items() if i != q}
        out[q] = sorted(score.items(), key=lambda p: (-round(p[1], 9), p[0]))[:k]
    return out


def test_nearest_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(vectors, [i for i in vectors if i % 50 == 0], 5)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 6))
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        for _, i, score in found:
            a, b = (np.asarray(vectors[x], float) for x in (q, i))
            assert abs(score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
        hits += len({f[1] for f in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 5 * len(want)


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (5, None), (100, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [1.0, None]), (9, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rep int, v string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1): (3, 1.0), (0, 2): (50, 1.0), (0, 3): (4, 0.0), (50, 1): (0, 1.0), (50, 2): (3, 1.0), (50, 3): (4, 0.0)}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("n", [20_000, 100_000])
def test_nearest_at_scale(spark, n):
    """Clustered vectors: recall, and the share of the rows that a query meets."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(n // 50, 24))[rng.integers(0, n // 50, n)] + 0.25 * rng.normal(size=(n, 24))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 24).cast(pa.list_(pa.float32()))}))
    asked = n // 200
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % asked == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = ann.unit(x)
    hits = 0
    for q in range(0, n, asked):
        score = unit @ unit[q]
        score[q] = -2
        hits += len(got[q] & set(np.argpartition(-score, 5)[:5].tolist()))
        assert len(got[q]) == 5
    assert hits >= 0.9 * 5 * len(got)
    drawn = unit[: ann.SAMPLE_ROWS]
    forest = ann.grow(drawn, ann.TREES, max(2, ann.LEAF_ROWS * len(drawn) // n))
    visits, leaves = ann.calibrated(forest, drawn, 5, ann.RECALL), forest.leaves_of(unit)
    met = [np.isin(leaves, forest.visit(unit[q], visits)).any(1).mean() for q in range(0, n, 10 * asked)]
    assert np.mean(met) < 0.1


def test_nearest_few_in_a_leaf(spark):
    """Leaves of two rows, one of them visited: queries go on until they have k rows."""
    rows = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, trees=1, leaf_rows=2, visited=1).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {q: len(v) for q, v in got.items()} == {0: 5, 10: 5, 20: 5, 30: 5}
    few = df.where("vec_id < 4")
    assert ann.nearest(few, F.col("vec_id") == 0, trees=1, leaf_rows=2, visited=1).count() == 3


def test_forest_is_bounded(monkeypatch):
    monkeypatch.setattr(ann, "FOREST_BYTES", 40_000)
    x = ann.unit(np.random.default_rng(1).normal(size=(3_000, 50)))
    forest = ann.grow(x, 4, 2)
    assert forest.planes.nbytes <= 40_000 and len(np.unique(forest.leaves_of(x)[:, 3])) > 10


def test_sets_are_mixed_once_and_bare_ones_told_without(monkeypatch):
    rng, mixed = np.random.default_rng(5), []
    plain = nearjoin.splitmix
    monkeypatch.setattr(nearjoin, "splitmix", lambda x: mixed.append(np.size(x)) or plain(x))
    for n in (0, 1, 4, 17, 40, 200, 500, 3000):
        for spread in (1, 1 << 6):
            s = np.sort(rng.integers(0, (1 << 63) // spread, n).astype(np.uint64) * np.uint64(2))
            segments = [(m, slack, len({int(x) * m >> 64 for x in (s >> np.uint64(32) << np.uint64(32)).tolist()})) for _, m, slack in nearjoin.bands_of(n)]
            mixed.clear()
            assert nearjoin.is_bare(s) == any(m and m - k > slack for m, slack, k in segments) and not mixed
            found = nearjoin.signatures(s)
            assert len(found) == sum(k if m else n for m, _, k in segments)
            assert sum(mixed) <= n + 2 * len(found)


def test_runs_in_blocks_are_as_over_the_whole():
    hashes = np.random.default_rng(6).integers(0, 1 << 63, 300_000).astype(np.uint64)
    starts = np.arange(len(hashes) - 19)
    base = words._MULTIPLIER + 2 * 20 + 2 * 1
    assert (words.run_hashes(hashes, 20, 1) == words._stretches(hashes, starts, starts + 20, base)).all()
    assert (words.distinct(hashes % np.uint64(1000)) == np.arange(1000)).all() and not len(words.distinct(hashes[:0]))
    words._kept_powers.cache_clear()
    tracemalloc.start()
    for length, salt in ((5, 0), (8, 0), (20, 1), (20, 2)):
        words.run_hashes(hashes, length, salt)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 10_000_000  # of powers that a worker keeps; they were of the length of what was hashed
