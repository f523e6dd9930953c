"""Privacy, page and training-corpus analytics as plain Spark DataFrame operators."""
