"""brindle: retrieval and LLM-operations analytics as Spark DataFrame operators."""
