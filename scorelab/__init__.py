"""scorelab: model-evaluation analytics on Spark DataFrames.

Column-level building blocks live in ``scorelab.functions`` (Column -> Column),
table-level operators in ``scorelab.operators`` (DataFrame -> DataFrame),
readers and writers in ``scorelab.sources``, Structured Streaming jobs in
``scorelab.streaming`` and the mapped test relations plus the registered
query catalog in ``scorelab.plans``.
"""

__version__ = "0.1.0"
