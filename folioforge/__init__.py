"""folioforge: document analytics expressed as Spark DataFrame plans."""
