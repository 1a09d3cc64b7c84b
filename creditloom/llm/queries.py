"""The operators' queries, one for each numbered operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audio import op1_audio_features
from .divergence import OP12_SQL, op12_source_divergence
from .langid import op6_language_id
from .linedup import op8_line_dedup
from .lmscore import op10_lm_scoring
from .neardup import OP5_SQL, op5_minhash_neardup
from .packing import op4_best_fit_packing
from .pieces import op9_sentencepiece
from .sharding import op2_minimax_sharding
from .spelling import op13_spelling_variants
from .topk import OP3_SQL, op3_maxscore_topk
from .toxicity import op7_toxicity
from .urlrules import OP11_SQL, op11_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_audio_features,
            op2_minimax_sharding,
            op3_maxscore_topk,
            op4_best_fit_packing,
            op5_minhash_neardup,
            op6_language_id,
            op7_toxicity,
            op8_line_dedup,
            op9_sentencepiece,
            op10_lm_scoring,
            op11_url_filters,
            op12_source_divergence,
            op13_spelling_variants,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_maxscore_topk": OP3_SQL, "op5_minhash_neardup": OP5_SQL, "op11_url_filters": OP11_SQL, "op12_source_divergence": OP12_SQL}
