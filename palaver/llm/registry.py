"""The registered queries of the corpus operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op3_sentencepiece_byte_bpe
from .exact_dedup import OP6_SQL, op6_block_naming_dedup
from .lines import OP4_SQL, op4_deletion_neighbourhood
from .minhash import op1_minhash_near_dedup
from .packing import op10_cutting_stock_packing
from .pii import op8_crf_personal_data
from .quality import op7_weak_supervision
from .sharding import OP9_SQL, op9_rendezvous_sharding
from .spans import op5_sentence_spans
from .warc import OP2_SQL, op2_warc_index_merge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_warc_index_merge": op2_warc_index_merge,
    "op3_sentencepiece_byte_bpe": op3_sentencepiece_byte_bpe,
    "op4_deletion_neighbourhood": op4_deletion_neighbourhood,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_block_naming_dedup": op6_block_naming_dedup,
    "op7_weak_supervision": op7_weak_supervision,
    "op8_crf_personal_data": op8_crf_personal_data,
    "op9_rendezvous_sharding": op9_rendezvous_sharding,
    "op10_cutting_stock_packing": op10_cutting_stock_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_index_merge": OP2_SQL,
    "op4_deletion_neighbourhood": OP4_SQL,
    "op6_block_naming_dedup": OP6_SQL,
    "op9_rendezvous_sharding": OP9_SQL,
}
