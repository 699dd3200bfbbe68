"""The registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from .op01_forest import op1_prefix_forest
from .op02_quality import OP2_SQL, op2_line_first_cleaning
from .op03_simhash import op3_bit_sliced_simhash
from .op04_html import op4_host_consensus
from .op05_mixing import OP5_SQL, op5_systematic_mix
from .op06_warc import op6_warc_pages
from .op07_sharding import op7_rendezvous
from .op08_packing import op8_cutting_stock
from .op09_toxicity import op9_subword_softmax
from .op10_lines import op10_fuzzy_lines
from .op11_minhash import op11_tensored_minhash
from .op12_merkle import op12_merkle_manifest
from .op13_trie import op13_prefix_trie

QUERIES = {f.__name__: f for f in (
    op1_prefix_forest,
    op2_line_first_cleaning,
    op3_bit_sliced_simhash,
    op4_host_consensus,
    op5_systematic_mix,
    op6_warc_pages,
    op7_rendezvous,
    op8_cutting_stock,
    op9_subword_softmax,
    op10_fuzzy_lines,
    op11_tensored_minhash,
    op12_merkle_manifest,
    op13_prefix_trie,
)}
ORACLES = {"op2_line_first_cleaning": OP2_SQL, "op5_systematic_mix": OP5_SQL}
