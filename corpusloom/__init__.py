"""Document-intelligence operators expressed as Spark DataFrame plans."""
