"""Review analytics expressed as Spark DataFrame operators."""
