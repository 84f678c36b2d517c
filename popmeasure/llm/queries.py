"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, clusters, digest, jaccard, language, mixing, negatives, novelty, pseudonyms, quality, repeats, sharding, simhash


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_language": language.op1_language,
        "op2_digests": digest.op2_digests,
        "op3_repeats": repeats.op3_repeats,
        "op4_quality": quality.op4_quality,
        "op5_bpe": bpe.op5_bpe,
        "op6_mixing": mixing.op6_mixing,
        "op7_secrets": novelty.op7_secrets,
        "op8_pseudonyms": pseudonyms.op8_pseudonyms,
        "op9_sharding": sharding.op9_sharding,
        "op10_simhash": simhash.op10_simhash,
        "op11_jaccard": jaccard.op11_jaccard,
        "op12_clusters": clusters.op12_clusters,
        "op13_negatives": negatives.op13_negatives,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_sharding": sharding.op9_sql(), "op11_jaccard": jaccard.op11_sql(), "op12_clusters": clusters.op12_sql(), "op13_negatives": negatives.op13_sql()}
