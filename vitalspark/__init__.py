"""vitalspark: per-user activity analytics (steps, distance, calories, sleep,
heart rate, metabolic intensity) as Spark DataFrame operators.

Layout
------
sources/    fixed schemas, CSV/Parquet readers, event-log -> logical tables
functions/  Column-level expressions (weekday, parsing, bucketing, sums)
operators/  DataFrame -> DataFrame operators (cleaning, quality checks,
            aggregates, joins, line fits, sampling, numbering)
plans/      the named analyses, the query registry and the SQL oracles
streaming/  the daily roll-up expressed over a Structured Streaming source

Every operator is lazy (returns a DataFrame) unless its docstring says it
materialises a small, size-checked side table.
"""

__version__ = "0.1.0"
