"""Queries over the driver's tables, one for each operator, and the pipeline; SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from .decontamination import op5_benchmark_decontamination
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import OP2_SQL, op2_mixing
from .sharding import LAWS_SQL, op6_sharding, sharding_laws
from .simhash import op7_simhash_near_dedup
from .token_counts import op4_token_counts
from .token_output import op10_token_output
from .topk import OP1_SQL, op1_exact_top_k
from .toxicity import op3_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_top_k, op2_mixing, op3_toxicity, op4_token_counts, op5_benchmark_decontamination,
        op6_sharding, op7_simhash_near_dedup, op8_warc, op9_line_dedup, op10_token_output, sharding_laws,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES = {"op1_exact_top_k": OP1_SQL, "op2_mixing": OP2_SQL, "op8_warc": OP8_SQL, "op9_line_dedup": OP9_SQL, "sharding_laws": LAWS_SQL}
