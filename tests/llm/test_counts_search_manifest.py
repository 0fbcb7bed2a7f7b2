"""Token counts against the library, ranked search and the manifest against SQL and plain versions."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.conftest import ODD, PASSAGE, docs_of
from tests.llm.test_operators import key, same
from vitreon.llm import lexical, manifest, tokencounts

SMALL = "/root/testdata/sf0.001"


def twin(sql):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con.execute(sql).fetchall()


# --- 11 --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ready():
    return tokencounts.prepare(tokencounts.tokenizer())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(tokencounts.tokenizer().decode())


def sizes(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, odd, none, small, library):
    for docs in (odd, small):
        rows = docs.select("doc_id", "text").collect()
        n = sizes(library, [r.text or "" for r in rows])
        want = [(r.doc_id, len((r.text or "").encode()), x, x > 1024) for r, x in zip(rows, n, strict=True)]
        got = tokencounts.count(docs, tokencounts.tokenizer())
        same(got.drop("n_direct").collect(), want)
        assert got.where("n_direct > n_tokens").isEmpty()
    assert tokencounts.count(none, tokencounts.tokenizer()).collect() == []


def test_whole_tokens_are_proven(ready, library):
    """Every string that is said to be one token is one, and none that is one is left out."""
    from_vocabulary = [s for s in json.loads(tokencounts.tokenizer())["model"]["vocab"]]
    letters = tokencounts.byte_letters()
    words = [w for w in (bytes(letters[c] for c in s).decode("utf-8", "ignore") for s in from_vocabulary) if w]
    alone = set(ready["alone"])
    whole = [w for w in words if len(library.pre_tokenizer.pre_tokenize_str(w)) == 1]
    assert [w in alone for w in whole] == [n == 1 for n in sizes(library, whole)]
    assert len(alone) > 49_000


def test_characters_of_all_editions(ready, library):
    """Letters, digits and blanks are those of the library, whose Unicode isn't that of the regex module."""
    points = [*range(0xD800), *range(0xE000, 0x30000)]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[i : i + 97]) for i in range(0, len(points), 97)]
    assert tokencounts.Merges(ready).count_batch(texts)[0] == sizes(library, texts)


def test_added_and_long(ready, library, monkeypatch):
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "x" * 3000, "word it's " * 150_000, " \n\t  \x1c\x85 "]
    merges = tokencounts.Merges(ready, words_kept=1)
    assert merges.count_batch(texts)[0] == sizes(library, texts) == merges.count_batch(texts)[0]


def test_files_that_are_refused():
    spec = json.loads(tokencounts.tokenizer())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            tokencounts.prepare(json.dumps(spec | change).encode())


# --- 12 --------------------------------------------------------------------------------------------

ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "Long TEXT é word word"), (3, None), (4, " ?! "), (5, "nowhere"), (None, "x y word"), (6, "日本語 🎉 x")]


def test_search_odd(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id long, text string, rank int, doc_id long")
    ties = docs_of(spark, [(50 - i, "word " + "x " * (i % 3), "s") for i in range(40)])
    docs = odd.unionByName(ties).repartition(7)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute.lexical(rows, ITEMS)
    cols = ("item_id", "rank", "doc_id", "score")
    same(lexical.search(docs, items).select(*cols).collect(), want)
    monkeypatch.setattr(lexical, "SEGMENT", 300)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    same(lexical.search(docs, items).select(*cols).collect(), want)
    same(lexical.search(docs, items, k=2).select(*cols).collect(), brute.lexical(rows, ITEMS, 2))
    for some, of in ((none, items), (docs, items.limit(0)), (docs.where("text is null"), items)):
        assert lexical.search(some, of).collect() == []


def test_search_sql(spark, small):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = lexical.search(small, items).select("item_id", "rank", "doc_id", "score").collect()
    same(got, twin(lexical.ORACLE))
    same(got, brute.lexical([tuple(r) for r in small.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()]))


@pytest.mark.parametrize("fan", [1, 3, 5])
def test_tree_finds_the_best(fan):
    """With ties, and with scores of earlier segments: what can be among the k best, and few nodes are opened."""
    rng = np.random.default_rng(fan)
    n, v = 1000, 40
    doc, term = np.divmod(np.unique(rng.integers(0, n * v, 6000)), v)
    impact = rng.integers(1, 6, len(doc)) * 100
    levels, root = lexical.build(doc, term, impact, n, v, fan)
    for k in (1, 10):
        for least, had in ((1, []), (1500, []), (1, [1900] * 4), (1, [2500] * 12)):
            terms = np.sort(rng.choice(v, 6, replace=False))
            weights = rng.integers(0, 5, 6)
            w = np.zeros(v, np.int64)
            w[terms] = weights
            scores = np.zeros(n, np.int64)
            np.add.at(scores, doc, impact * w[term])
            got = lexical.search_tree(levels, lexical.root_bound(root, terms, weights), terms, weights, v, k, least, had[:k], fan)
            floor = max(least, sorted([*had[:k], *scores[scores > 0].tolist()])[-k:][0] if len(scores) else 1)
            assert sorted(got) == sorted((int(s), d) for d, s in enumerate(scores.tolist()) if s >= max(1, floor))


def test_terms_with_one_hash(monkeypatch):
    """A word whose hash is a term's but whose bytes aren't is none."""
    voc = lexical.Vocabulary([b"alpha", b"beta", "é".encode()])
    data = np.frombuffer("alpha gamma. Beta\u00e9 \u00e9 BETA".encode(), np.uint8)
    low, starts, ends, h = lexical.terms_of(data, voc.keys)
    h[1] = h[0]
    there, term = voc.find(low, starts, ends, h)
    assert [(t, int(n)) for t, n in zip(there.tolist(), term, strict=True)] == [(0, 0), (3, 2), (4, 1)]


# --- 13 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("bits", "upper"), [(14, 10), (2, 1), (1, 2)])
def test_manifest_odd(spark, odd, none, bits, upper):
    extra = docs_of(spark, [(i, f"text {i}", f"s{i % 3}") for i in range(100, 137)])
    for docs in (
        odd.unionByName(extra).withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("l"), F.col("doc_id") % 4))),
        odd.withColumn("n_chars", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string")),
        odd.limit(1),
        none,
    ):
        rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
        got = manifest.manifest(docs, bits, upper).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute.manifest(rows), key=key)


def test_manifest_sql(small):
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = manifest.query(small.sparkSession, small).select(*cols)
    same(got.collect(), twin(manifest.ORACLE))
    same(got.collect(), brute.manifest([tuple(r) for r in small.select("doc_id", "source", "lang", "n_chars", "text").collect()]))
    assert got.where("verified").count() == small.where("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 0 or n_chars is null").count()
