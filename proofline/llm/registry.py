"""The queries of this subpackage by name, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from proofline.llm import byte_bpe, collocations, html_extract, license_scan, mixing, neighbour_quality, ngram_join, quality_rules, sentence_pieces, spelling, suffix_dedup, tiff, toxicity
from proofline.session import ship


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_neighbour_quality": neighbour_quality.query,
        "op2_toxicity": toxicity.query,
        "op3_ngram_join": ngram_join.query,
        "op4_quality_rules": quality_rules.query,
        "op5_byte_bpe": byte_bpe.query,
        "op6_tiff": tiff.query,
        "op7_source_mixing": mixing.query,
        "op8_suffix_dedup": suffix_dedup.query,
        "op9_license_scan": license_scan.query,
        "op10_html_extract": html_extract.query,
        "op11_sentence_pieces": sentence_pieces.query,
        "op12_collocations": collocations.query,
        "op13_spelling_variants": spelling.query,
    }
    import corpus_pipeline

    return {name: _shipped(query) for name, query in found.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op4_quality_rules": quality_rules.SQL, "op9_license_scan": license_scan.SQL, "op12_collocations": collocations.SQL, "op13_spelling_variants": spelling.SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
