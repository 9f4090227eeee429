"""Knowledge-base quality and retrieval analytics as PySpark DataFrame operators."""
