"""Literature screening and corpus analytics as Spark DataFrame operators."""
