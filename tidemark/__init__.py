"""tidemark: temporal and relational analytics expressed as Spark plans."""
