"""Text, code and log analytics as Spark DataFrame plans."""
