"""The registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import ann, ngram_jaccard, substring_dedup, topk
from .ann import op2_ann
from .language_id import op10_language_id
from .licenses import op4_licenses
from .ngram_jaccard import op7_ngram_jaccard
from .packing import op6_packing
from .pii import op3_pii
from .piece_tokenizer import op9_sentencepiece
from .quality import op8_quality
from .substring_dedup import op5_substring_dedup
from .topk import op1_topk

QUERIES = {f.__name__: f for f in (op1_topk, op2_ann, op3_pii, op4_licenses, op5_substring_dedup, op6_packing, op7_ngram_jaccard, op8_quality, op9_sentencepiece, op10_language_id)}
ORACLE_SQL: dict[str, str] = {k: v for m in (topk, ann, substring_dedup, ngram_jaccard) for k, v in m.ORACLE_SQL.items()}
