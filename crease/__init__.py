"""crease: cricket analytics and SQL-answer evaluation as Spark DataFrame jobs.

Sub-packages
------------
sources    readers for the driver tables, match documents, datasets and result files
functions  column-expression helpers (cricket predicates, text rules, answer parsing)
operators  the DataFrame jobs: ingestion, quality checks, metrics, comparison, reports
plans      the registered queries and their DuckDB oracle SQL
streaming  restartable incremental jobs on Structured Streaming
"""

from crease.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
