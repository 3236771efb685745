"""Plan shapes used by several operators: totals, ranks, sequences and forests."""
