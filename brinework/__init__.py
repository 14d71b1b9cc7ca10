"""brinework: a Spark-first analytics engine for document-corpus data."""
