"""Newsletter and web-article analytics as Spark DataFrame operators."""
