"""Evidence-checked retrieval over clause-structured documents, on Spark."""
