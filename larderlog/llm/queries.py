"""The queries of this subpackage and the DuckDB SQL they must equal."""

from __future__ import annotations

from .decontamination import OP8_SQL, op8_benchmark_leaks
from .exact_dedup import OP6_SQL, op6_chunk_recipes
from .hard_negatives import OP12_SQL, op12_shared_lists
from .language_id import op13_kernel_languages
from .licenses import op3_license_scan
from .lm_scoring import op10_context_mixing
from .near_dedup import OP2_SQL, op2_chosen_path
from .sentencepieces import op4_piece_scan
from .sharding import op1_shard_ring
from .token_counts import op5_token_transducer
from .toxicity import op9_label_model
from .url_filter import OP7_SQL, op7_url_bloom
from .whitening import op11_spectrum_slices

QUERIES = {
    f.__name__: f
    for f in (
        op1_shard_ring, op2_chosen_path, op3_license_scan, op4_piece_scan, op5_token_transducer, op6_chunk_recipes,
        op7_url_bloom, op8_benchmark_leaks, op9_label_model, op10_context_mixing, op11_spectrum_slices, op12_shared_lists,
        op13_kernel_languages,
    )
}
ORACLES = {
    "op2_chosen_path": OP2_SQL, "op6_chunk_recipes": OP6_SQL, "op7_url_bloom": OP7_SQL, "op8_benchmark_leaks": OP8_SQL,
    "op12_shared_lists": OP12_SQL,
}
