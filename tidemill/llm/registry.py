"""Queries of this subpackage and the SQL they are checked against, where SQL can express them."""

from __future__ import annotations

from . import fill_middle, mixing, secret_scan
from .brown_lm import op3_lm_score
from .embedding_dedup import op13_embedding_dedup
from .fill_middle import op12_fill_in_middle
from .fingerprint import op7_fingerprint
from .html_extract import op2_html_extract
from .language_id import op6_language_id
from .media_store import op9_media_columns
from .minhash_dedup import op4_minhash_dedup
from .mixing import op5_mixing
from .secret_scan import op10_secret_scan
from .sentencepiece_codec import op8_sentencepiece
from .spelling import op11_spelling_groups
from .substring_dedup import op1_substring_dedup

OPERATORS = (op1_substring_dedup, op2_html_extract, op3_lm_score, op4_minhash_dedup, op5_mixing, op6_language_id, op7_fingerprint, op8_sentencepiece, op9_media_columns, op10_secret_scan, op11_spelling_groups, op12_fill_in_middle, op13_embedding_dedup)


def queries() -> dict:
    import corpus_pipeline

    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    known = {"op5_mixing": mixing.oracle(), "op10_secret_scan": secret_scan.oracle(), "op12_fill_in_middle": fill_middle.oracle()}
    return known | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
