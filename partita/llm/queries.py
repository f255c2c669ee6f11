"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .langid import op9_rank_order_langid
from . import line_template, ngram_join
from .ann_scan import op4_adaptive_scan_ann
from .line_template import op5_line_template_dedup
from .ngram_join import op2_ngram_jaccard_join
from .packing import op6_best_fit_packing
from .pii import op7_pii_weak_supervision
from .quality_crf import op3_quality_rules
from .sentencepiece_topk import op1_sentencepiece_topk
from .token_hist import op8_length_histogram
from .token_output import op10_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sentencepiece_topk, op2_ngram_jaccard_join, op3_quality_rules, op4_adaptive_scan_ann, op5_line_template_dedup, op6_best_fit_packing, op7_pii_weak_supervision, op8_length_histogram, op9_rank_order_langid, op10_token_files)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": ngram_join.ORACLE, "op5_line_template_dedup": line_template.ORACLE}
