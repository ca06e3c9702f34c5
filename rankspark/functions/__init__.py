"""Column expressions (built-in Spark functions only)."""

from rankspark.functions.arrays import (  # noqa: F401
    add_arrays,
    ap_scaled,
    borda_points,
    dot,
    lcm_upto,
    quantize,
    rank_desc,
    softmax_xent,
    top1,
    top_k,
)
from rankspark.functions.text import (  # noqa: F401
    NA_TOKENS,
    answer_correct,
    assessment,
    has_misconception,
    label_string,
    null_tokens,
    parse_candidates,
    render_prefix,
    word_count,
)
