"""Plan helpers: lineage cuts, skew-safe joins, worker shipping."""
