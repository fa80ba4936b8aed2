"""The queries of this package: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can express them."""

from __future__ import annotations

from loglake.llm import jaccard, language, media, packing, quality_model, quality_rules, secrets, sentencepieces, toxicity, url_filter

QUERIES = {
    "op1_ngram_jaccard": jaccard.query,
    "op2_sentencepiece": sentencepieces.query,
    "op3_media": media.query,
    "op4_url_filter": url_filter.query,
    "op5_quality_rules": quality_rules.query,
    "op6_language": language.query,
    "op7_quality_model": quality_model.query,
    "op8_toxicity": toxicity.query,
    "op9_packing": packing.query,
    "op10_secrets": secrets.query,
}
ORACLES: dict[str, str] = {"op1_ngram_jaccard": jaccard.ORACLE_SQL, "op4_url_filter": url_filter.oracle()}
