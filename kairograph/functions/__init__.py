"""Column expressions shared by the operators."""

from kairograph.functions.expressions import (
    choose,
    delta_of,
    fold_intervals,
    local_name,
    overlaps,
    pair_count,
    parse_resource_uri,
    pattern_support,
    rule_support,
)

__all__ = ["choose", "delta_of", "fold_intervals", "local_name", "overlaps", "pair_count", "parse_resource_uri", "pattern_support", "rule_support"]
