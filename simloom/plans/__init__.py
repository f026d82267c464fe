"""Plan-level building blocks: lineage cuts, dense numbering, order statistics, block pairs."""
