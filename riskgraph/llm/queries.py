"""The subpackage's registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express one."""

from __future__ import annotations

from .bagminhash import op5_bagminhash
from .chat import op2_reply_trees
from .lm_scoring import op1_suffix_tree
from .ogg import op8_ogg
from .pivot_index import op3_pivot_index
from .packing import op4_vector_packing
from .quality import op6_weak_labels
from .sharding import op10_label_propagation
from .toxicity import op9_noisy_channel
from .word_bpe import op7_word_bpe

QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_reply_trees": op2_reply_trees,
    "op3_pivot_index": op3_pivot_index,
    "op4_vector_packing": op4_vector_packing,
    "op5_bagminhash": op5_bagminhash,
    "op6_weak_labels": op6_weak_labels,
    "op7_word_bpe": op7_word_bpe,
    "op8_ogg": op8_ogg,
    "op9_noisy_channel": op9_noisy_channel,
    "op10_label_propagation": op10_label_propagation,
}

ORACLE_SQL: dict[str, str] = {}
