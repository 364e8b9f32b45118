"""ledgerline: account-balance snapshot analytics on Spark.

Layers (each a DataFrame -> DataFrame function, nothing collected to the driver):

* ``sources``   – driver-table adapters, landed JSON envelopes, sinks
* ``functions`` – column expressions (casts, predicates, time zones)
* ``operators`` – latest-version-per-key, keyed merge, staging, aggregates,
                  quality checks, date spines and loan roll-forwards
* ``plans``     – the model graph (staging -> dims/facts -> marts), the daily run
* ``streaming`` – incremental keyed merge on Structured Streaming
"""

__version__ = "0.1.0"
