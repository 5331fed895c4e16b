"""The queries of this subpackage and the SQL to compare them with."""

from __future__ import annotations

from kinshelf.llm.block_max import OP5_SQL, op5_block_max
from kinshelf.llm.chat import OP1_SQL, op1_prefix_target
from kinshelf.llm.decontaminate import OP9_SQL, op9_containment
from kinshelf.llm.difference_cover import OP4_SQL, op4_difference_cover
from kinshelf.llm.hard_negatives import OP11_SQL, op11_segment_summaries
from kinshelf.llm.language import op2_random_field
from kinshelf.llm.pack import op8_configuration_program
from kinshelf.llm.pii import op10_anchors
from kinshelf.llm.prefix_free import op3_prefix_free
from kinshelf.llm.repair import OP12_SQL, op12_suffix_dawg
from kinshelf.llm.simhash import op6_simhash
from kinshelf.llm.token_files import op13_wavelet_matrix
from kinshelf.llm.toxicity import op7_boosted_trees

QUERIES = {
    "op1_prefix_target": op1_prefix_target,
    "op2_random_field": op2_random_field,
    "op3_prefix_free": op3_prefix_free,
    "op4_difference_cover": op4_difference_cover,
    "op5_block_max": op5_block_max,
    "op6_simhash": op6_simhash,
    "op7_boosted_trees": op7_boosted_trees,
    "op8_configuration_program": op8_configuration_program,
    "op9_containment": op9_containment,
    "op10_anchors": op10_anchors,
    "op11_segment_summaries": op11_segment_summaries,
    "op12_suffix_dawg": op12_suffix_dawg,
    "op13_wavelet_matrix": op13_wavelet_matrix,
}

#: The others are compared with brute force or measured on held-out rows in the tests.
ORACLES = {
    "op1_prefix_target": OP1_SQL,
    "op4_difference_cover": OP4_SQL,
    "op5_block_max": OP5_SQL,
    "op9_containment": OP9_SQL,
    "op11_segment_summaries": OP11_SQL,
    "op12_suffix_dawg": OP12_SQL,
}
