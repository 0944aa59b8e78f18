"""Integer-range analytics on Spark DataFrames.

Ranges are rows: ``space`` (the group they belong to), ``rid`` (the row's number, since tables have no order), ``start``
and ``end`` (closed, so ``end = start - 1`` is an empty range before ``start``), and any further columns.  Every operator
takes and returns DataFrames and is lazy.
"""
