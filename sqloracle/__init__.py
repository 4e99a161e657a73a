"""DuckDB SQL texts used as the independent oracle for ``__spark_entry__.queries()``.

Every statement is a single SELECT (CTEs allowed) over the pre-registered views. The stemmer is written
here as a CTE chain of CASE expressions over a vocabulary relation; the Spark side uses column
expressions instead. Both read the fixed rule tables (suffix lists, stop words) from the same constants,
and ``tests/porter_ref.py`` checks both against an independent plain-Python stemmer.
"""
