"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_cross_tokenizer_alignment
from .bpe import op5_bpe_encode_decode
from .htmltext import op10_html_extraction
from .licenses import op11_license_scans
from .lm import op4_lm_scoring
from .packing import op6_best_fit_packing
from .simhash import op9_simhash_near_dedup
from .spelling import OP13_SQL, op13_spelling_variant_grouping
from .suffixdup import op8_suffix_array_dedup
from .topk import OP2_SQL, op2_exact_topk
from .toxicity import op7_toxicity
from .urlfilter import op1_url_filters
from .vectordup import op3_embedding_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filters, op2_exact_topk, op3_embedding_near_dedup, op4_lm_scoring, op5_bpe_encode_decode, op6_best_fit_packing, op7_toxicity, op8_suffix_array_dedup, op9_simhash_near_dedup, op10_html_extraction, op11_license_scans, op12_cross_tokenizer_alignment, op13_spelling_variant_grouping)}

ORACLES: dict[str, str] = {"op2_exact_topk": OP2_SQL, "op13_spelling_variant_grouping": OP13_SQL}
