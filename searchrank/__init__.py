"""searchrank: search-log ranking pipeline on Spark DataFrames.

Subpackages: ``sources`` (readers, writers, fixture view), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame transformations, metrics and
models), ``plans`` (end-to-end pipelines).
"""

__version__ = "0.1.0"
