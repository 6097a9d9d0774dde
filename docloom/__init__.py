"""docloom: document analytics, retrieval and evaluation as Spark DataFrame transforms."""
