"""Training-data operators on Spark: one module an operator, queries in ``llm.queries``."""
