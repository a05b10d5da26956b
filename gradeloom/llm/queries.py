"""All queries of this subpackage."""

from gradeloom.llm import (  # noqa: F401
    q_decontaminate,
    q_divergence,
    q_html_blocks,
    q_jaccard_join,
    q_line_dedup,
    q_license_scan,
    q_packing,
    q_quality_qda,
    q_quality_rules,
    q_secret_scan,
    q_shard_tree,
    q_topk_search,
    q_whitening,
)
from gradeloom.llm.registry import ORACLES, QUERIES  # noqa: F401
