"""Registry of the training-data queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from .collocations import OP11_SQL, op11_phrase_collocations
from .decontaminate import op10_latent_decontamination
from .html_text import op9_wrapper_extraction
from .jaccard import op5_jaccard_join
from .langid import op6_language_viterbi
from .packing import op3_best_fit_packing
from .periodic import op13_periodic_runs
from .pivot_search import op7_pivot_topk
from .sharding import op8_interleaved_sharding
from .simhash import op12_covering_simhash
from .suffix_dedup import op2_suffix_dedup
from .toxicity import op1_toxicity
from .url_filter import op4_url_markov_filter

QUERIES = {
    "op9_wrapper_extraction": op9_wrapper_extraction,
    "op10_latent_decontamination": op10_latent_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op1_toxicity": op1_toxicity,
    "op7_pivot_topk": op7_pivot_topk,
    "op6_language_viterbi": op6_language_viterbi,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_markov_filter": op4_url_markov_filter,
    "op8_interleaved_sharding": op8_interleaved_sharding,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_covering_simhash": op12_covering_simhash,
    "op13_periodic_runs": op13_periodic_runs,
}

#: DuckDB SQL by query, where SQL can express the operator.
ORACLE: dict[str, str] = {
    "op11_phrase_collocations": OP11_SQL,
}
