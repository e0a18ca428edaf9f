"""Social engagement analytics as Spark DataFrame operators."""
