"""codeloom: code-graph analytics as Spark DataFrame operations."""
