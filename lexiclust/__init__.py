"""Word-vector and corpus analytics as Spark DataFrame operators."""
