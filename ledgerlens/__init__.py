"""ledgerlens — commerce and delivery analytics as Spark DataFrame plans.

Subpackages:
  sources    table schemas, loaders, the proxy view over the driver star schema, export
  functions  column expressions (time, geo, numeric guards)
  operators  generic DataFrame -> DataFrame operators (validation, profiling,
             ordering/splits, features, evaluation, drift, matching, models)
  plans      the four pipelines (segmentation, delivery risk, causal, data products)
             and the query registry used by ``__spark_entry__``
  llm        training-data operators (near-dedup, BPE, language ID, ...), used by nothing else here
"""

__version__ = "0.1.0"
