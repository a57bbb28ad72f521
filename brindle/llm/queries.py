"""The queries of this package, and SQL where it can express them."""

from __future__ import annotations

from brindle.llm import decontam, mixing, quality_rules, warc
from brindle.llm.decontam import op9_benchmark_windows
from brindle.llm.lm_score import op3_log_bilinear_scores
from brindle.llm.mixing import op7_mix_to_weights
from brindle.llm.ordinal import op4_ordinal_quality
from brindle.llm.quality_rules import op2_host_quality_rules
from brindle.llm.sharding import op10_histogram_shards
from brindle.llm.simhash import op5_simhash_components
from brindle.llm.token_count import op8_whole_token_counts
from brindle.llm.toxicity import op6_positive_unlabelled_toxicity
from brindle.llm.warc import op1_arc_to_warc

QUERIES = {f.__name__: f for f in (op1_arc_to_warc, op2_host_quality_rules, op3_log_bilinear_scores, op4_ordinal_quality, op5_simhash_components, op6_positive_unlabelled_toxicity, op7_mix_to_weights, op8_whole_token_counts, op9_benchmark_windows, op10_histogram_shards)}
SQL: dict[str, str] = {"op1_arc_to_warc": warc.SQL, "op9_benchmark_windows": decontam.SQL, "op2_host_quality_rules": quality_rules.SQL, "op7_mix_to_weights": mixing.SQL}
