"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe
from .chat import op5_chat
from .classifier import op7_quality
from .curriculum import OP4_SQL, op4_curriculum
from .forest import OP12_SQL, op12_near_copies
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .katz import op1_katz
from .lexical import OP13_SQL, op13_lexical
from .perplexity import op2_quality_rules
from .secrets import op10_secrets
from .topk import OP9_SQL, op9_top_k
from .trie_join import OP6_SQL, op6_trie_join
from .warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz": op1_katz,
    "op2_quality_rules": op2_quality_rules,
    "op3_bpe": op3_bpe,
    "op4_curriculum": op4_curriculum,
    "op5_chat": op5_chat,
    "op6_trie_join": op6_trie_join,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_top_k": op9_top_k,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_near_copies": op12_near_copies,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op4_curriculum": OP4_SQL,
    "op6_trie_join": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op9_top_k": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_near_copies": OP12_SQL,
    "op13_lexical": OP13_SQL,
}
