"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .compaction import OP8_SQL, op8_sharding
from .htmlcrf import op3_html
from .media import op7_media
from .neardup import op1_neardup
from .packing import op5_packing
from .piecebpe import op6_pieces
from .quality import op10_quality
from .secretscan import op12_secrets
from .spelling import OP13_SQL, op13_variants
from .tokenout import op2_token_output
from .toxicity import op4_toxicity
from .turntrie import OP11_SQL, op11_trie
from .vafile import OP9_SQL, op9_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neardup": op1_neardup,
        "op2_token_output": op2_token_output,
        "op3_html": op3_html,
        "op4_toxicity": op4_toxicity,
        "op5_packing": op5_packing,
        "op6_pieces": op6_pieces,
        "op7_media": op7_media,
        "op8_sharding": op8_sharding,
        "op9_topk": op9_topk,
        "op10_quality": op10_quality,
        "op11_trie": op11_trie,
        "op12_secrets": op12_secrets,
        "op13_variants": op13_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_sharding": OP8_SQL, "op9_topk": OP9_SQL, "op11_trie": OP11_SQL, "op13_variants": OP13_SQL}
