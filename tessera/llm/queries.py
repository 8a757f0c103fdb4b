"""Registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame,
and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import functools

from ..session import ship_package
from . import chat_views, decontam, jaccard, lexical, licenses, lines, mixing, ppm, quality, sharding, suffix_dedup, token_coder, variants

_ALL = {
    "op11_lexical_search": (lexical.op11_lexical_search, lexical.SQL),
    "op12_spelling_variants": (variants.op12_spelling_variants, None),
    "op13_line_dedup": (lines.op13_line_dedup, lines.SQL),
    "op7_token_files": (token_coder.op7_token_files, None),
    "op10_license_scan": (licenses.op10_license_scan, licenses.SQL),
    "op1_perspective_rotation": (chat_views.op1_perspective_rotation, chat_views.SQL),
    "op4_suffix_dedup": (suffix_dedup.op4_suffix_dedup, None),
    "op2_ppm_scores": (ppm.op2_ppm_scores, None),
    "op3_pfair_mixing": (mixing.op3_pfair_mixing, None),
    "op5_label_propagation": (sharding.op5_label_propagation, None),
    "op8_ngram_jaccard_join": (jaccard.op8_ngram_jaccard_join, jaccard.SQL),
    "op6_decontamination": (decontam.op6_decontamination, decontam.SQL),
    "op9_quality_rules": (quality.op9_quality_rules, quality.SQL),
}


def _shipped(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir.rstrip("/"))
    return run


QUERIES = {k: _shipped(f) for k, (f, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items() if sql}
