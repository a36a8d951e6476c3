"""Search and retrieval analytics expressed as Spark DataFrame plans."""
