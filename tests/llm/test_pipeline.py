"""The pipeline's stages against plain versions of them, each on the rows that the stage before it kept."""

import hashlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest

from tests.llm import brute
from tests.llm.conftest import ODD, docs_of
from tests.llm.test_operators import reference_tokens
from vitreon.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(rows before, rows after) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    base = tmp_path_factory.mktemp("pipeline")
    for k, (_, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append((before, docs))
    return out


def test_shape(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    for before, after in stages[:-1]:
        assert before.schema.simpleString() == after.schema.simpleString()


def test_toxicity(spark, stages):
    """A naive scorer with the fitted weights: word by word, sentence by sentence."""
    before, after = (df.collect() for df in stages[0])
    w, b = toxicity.fit(stages[0][0], spark.read.parquet(f"{SF}/labels.parquet"))
    keep = []
    for r in before:
        log_not, text = 0.0, r.text.encode()
        raw, start = [], 0
        for i, c in enumerate(text):
            if c in b".!?\n":
                raw.append(text[start : i + 1])
                start = i + 1
        for s in [*raw, text[start:]]:
            if not s.translate(None, b" \t\n\v\f\r.,;:!?\"'()[]{}|*#%&$"):
                continue
            x, sent, _, _ = toxicity.features(np.frombuffer(s, np.uint8), np.array([0, len(s)]))
            log_not -= np.logaddexp(0, b + sum(float(w[f]) for word in x for f in word))
        if 1 - np.exp(log_not) < 0.5:
            keep.append(r.doc_id)
    assert sorted(keep) == sorted(r.doc_id for r in after)
    assert 0 < len(after) < len(before)


def test_lines(stages):
    before, after = (df.collect() for df in stages[1])
    want = {i: t for i, _, _, t in brute.line_dedup([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == want and len(after) == len(before)
    assert all(r.n_chars == len(r.text) for r in after)


def test_groups(stages):
    before, after = (df.collect() for df in stages[2])
    comp = brute.ngram_join([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in comp if i == c)
    text = {r.doc_id: r.text for r in before}
    assert all(r.text == text[r.doc_id] for r in after)


def test_mixture(stages):
    before, after = (df.collect() for df in stages[3])
    times = Counter(r.doc_id for r in after)
    mixed = {r.doc_id: r.copies for r in mixing.mix(stages[3][0]).collect()}
    assert times == Counter({i: c for i, c in mixed.items() if c})
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(brute.WORD.findall(r.text))
    assert abs(sum(len(brute.WORD.findall(r.text)) for r in after) / sum(sizes.values()) - 1.5) < 0.1


def test_tokens(stages):
    before, after = (df.collect() for df in stages[4])
    want = Counter((r.doc_id, tuple(x)) for r, x in zip(before, reference_tokens([r.text for r in before]), strict=True))
    assert Counter((r.doc_id, tuple(r.ids)) for r in after) == want


def test_decoded(spark):
    """The last stage's ids decode to the text that went in; a null text to the empty string."""
    docs = docs_of(spark, ODD)
    got = Counter((r.doc_id, r.decoded_sha256) for r in P.encode(spark, docs, SF).collect())
    assert got == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ODD)


def test_run(spark, stages):
    got = P.run(spark, SF)
    digest = lambda rows: Counter((r.doc_id, hashlib.sha256(str(list(r.ids)).encode()).hexdigest()) for r in rows)
    assert digest(got.collect()) == digest(stages[4][1].collect())


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows and clashing columns pass every stage; an empty table gives an empty one."""
    for docs in (docs_of(spark, ODD), docs_of(spark, ODD).limit(0)):
        n = []
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF)
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
            n.append(len(rows))
        assert n == [0] * 5 or n[0] >= len(ODD) - 1 and n[1] == n[0] and 0 < n[2] < n[1] and n[3] == n[4]
