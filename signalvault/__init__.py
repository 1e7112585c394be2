"""Shot / tree / signal recordings as Spark tables.

Acquisition planning, outcome ledgers, keyed merging, tolerant comparison and
conflict-safe renaming, written as DataFrame jobs.
"""
