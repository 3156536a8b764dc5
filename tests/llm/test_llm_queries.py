"""URL filters, registered queries and the pipeline."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from orbweave.llm import langid, secrets, urls
from test_llm_pairs import brute_components, brute_kept


def fits(host, path, rule):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


@pytest.mark.parametrize("ranges", [1, 7])
def test_urls(spark, ranges):
    rng = random.Random(5)
    label = lambda: rng.choice(("a", "b", "net", "org", "x-y"))
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda: "/" + "/".join(rng.choice(("en", "e", "de")) for _ in range(rng.randint(0, 3)))
    rules = {(host(rng.randint(1, 3)), path()): rng.choice(("allow", "block")) for _ in range(60)}
    rows = [(i, f"{rng.choice(('http', 'HTTPS'))}://{host(rng.randint(1, 4)).upper()}{path()}{rng.choice(('', '?q=/en', '#f'))}") for i in range(500)]
    rows += [(600, None), (601, ""), (602, "a.net/en"), (603, "x://"), (604, "x://://a"), (605, "x://a\n.net/e\nn"), (None, "http://net/"), (606, "http://Ä.net/ü"), (607, "http://net/"), (607, "http://net/")]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, host string, key int")
    asked = spark.createDataFrame([(*r, v) for r, v in rules.items()] + [("q", None, "block")], "host string, path string, verdict string")
    got = sorted(map(tuple, urls.judge(df, asked, ranges=ranges).collect()), key=repr)
    seen = {}
    for i, h, p, rule, verdict in got:
        best = max((len(r[0]) + len(r[1]) for r in rules if fits(h, p, r)), default=None)
        assert (rule is None) == (best is None)
        if rule is None:
            assert verdict == "allow"
        else:
            assert len(rule) == best and verdict in {v for r, v in rules.items() if r[0] + r[1] == rule}
        seen[i] = (h, p)
    assert len(got) == len(rows)
    assert seen[600] == seen[601] == seen[602] == seen[603] == ("", "")
    assert seen[606] == ("Ä.net", "/ü") and seen[605] == ("a\n.net", "/e\nn")
    assert urls.judge(df.limit(0), asked).count() == 0
    assert {r["verdict"] for r in urls.judge(df, asked.limit(0)).collect()} == {"allow"}


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    for name, sql in __spark_entry__.oracle_sql().items():
        if name.startswith("op"):
            got = __spark_entry__.queries()[name](spark, sf)
            want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_fourteen_queries():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names


def test_pipeline(spark, sf, tmp_path):
    """Each stage against brute force on what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    encoder = secrets.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    kept, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in kept.collect()}
        stage(spark, kept, sf).write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        if k + 1 == len(corpus_pipeline.STAGES):
            break
        assert kept.columns == columns and kept.schema == docs.schema
        after = {r["doc_id"]: r for r in kept.collect()}
        texts = {i: r["text"] for i, r in before.items()}
        if name == "language_id":
            letters = {i: sum(map(str.isalpha, t or "")) for i, t in texts.items()}
            assert all(letters[i] for i in after) and all(after[i] == before[i] for i in after)
            clean = [i for i in before if letters[i] >= 50 and before[i]["lang"] is not None]
            assert sum(i in after for i in clean) >= 0.99 * len(clean)
        if name == "near_duplicates":
            assert set(after) == {component for _, component in brute_components(list(texts.items())).values()} and all(after[i] == before[i] for i in after)
        if name == "substring_dedup":
            found = brute_kept(list(texts.items()))
            assert set(after) == {i for i, (n, gone, _) in found.items() if gone < n or not n}
            for i, r in after.items():
                assert r["text"] == texts[i] if not found[i][1] else hashlib.sha256(r["text"].encode()).hexdigest() == found[i][2]
        if name == "secret_scan":
            for i, r in after.items():
                covered = bytearray(len(texts[i]))
                for _, start, end in secrets.scan(texts[i], encoder, 2.2, 20)[1]:
                    covered[start:end] = b"x" * (end - start)
                assert r["text"].replace("[SECRET]", "") == "".join(c for c, gone in zip(texts[i], covered, strict=True) if not gone)
                assert secrets.base_spans(r["text"]) == []
            assert set(after) == set(before)
    places: dict = {}
    for r in kept.collect():
        places.setdefault(r["doc_id"], []).append(r)
    for i, r in after.items():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        for p in places[i]:
            assert zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
        assert sum(p["length"] for p in places[i]) == len(ids)
    assert set(places) == set(after)
    run = __spark_entry__.queries()["pipeline"](spark, sf)
    plain = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert plain(run) == plain(kept)


def test_pipeline_odd_rows(spark, sf):
    long_text = " ".join(f"the house of number {i} is old" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "123 456"), (4, "the old house is on the hill"), (5, "the old house is on the hill"), (None, "a house without number"), (6, long_text), (6, long_text)]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        kept = some
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, sf)
        ids = {r["doc_id"] for r in kept.collect()}
        assert ids <= {4, 6, None}
    assert langid.held_out() is not None
