"""The queries of this subpackage: name -> function of (spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, fingerprints, lexical, linededup, manifest, mixing, neardup, ngramjoin, quality, suffixdedup, surrogates, tokencounts, toxicity
from .common import sweep, table  # noqa: F401: sweep is for callers

QUERIES = {
    "op1_ngram_join": lambda spark, d: ngramjoin.query(spark, table(spark, d, "documents")),
    "op1_ngram_links": lambda spark, d: ngramjoin.query_links(spark, table(spark, d, "documents")),
    "op2_bpe": lambda spark, d: bpe.query(spark, table(spark, d, "documents")),
    "op3_line_dedup": lambda spark, d: linededup.query(spark, table(spark, d, "documents")),
    "op3_line_passages": lambda spark, d: linededup.query_passages(spark, table(spark, d, "documents")),
    "op4_pii_surrogates": lambda spark, d: surrogates.query(spark, table(spark, d, "documents")),
    "op5_embedding_neardup": lambda spark, d: neardup.query(spark, table(spark, d, "embeddings")),
    "op6_toxicity": lambda spark, d: toxicity.query(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_quality": lambda spark, d: quality.query(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_fingerprints": lambda spark, d: fingerprints.query(spark, table(spark, d, "documents")),
    "op9_suffix_dedup": lambda spark, d: suffixdedup.query(spark, table(spark, d, "documents")),
    "op10_mixing": lambda spark, d: mixing.query(spark, table(spark, d, "documents")),
    "op11_token_counts": lambda spark, d: tokencounts.query(spark, table(spark, d, "documents")),
    "op12_lexical_search": lambda spark, d: lexical.query(spark, table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_manifest": lambda spark, d: manifest.query(spark, table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op1_ngram_join": ngramjoin.ORACLE,
    "op3_line_dedup": linededup.ORACLE,
    "op3_line_passages": linededup.ORACLE_PASSAGES,
    "op5_embedding_neardup": neardup.ORACLE,
    "op9_suffix_dedup": suffixdedup.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_manifest": manifest.ORACLE,
}
