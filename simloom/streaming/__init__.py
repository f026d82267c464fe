"""Incremental work: extending networks and databases, and resuming interrupted runs.

The data model has no unbounded sources, event times or stateful streams. What grows over time
is a set of records, so the incremental operators are anti-joins against what is finished.
"""
