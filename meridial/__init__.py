"""Assessment and programming analytics as Spark DataFrame operators."""
