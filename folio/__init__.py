"""Analytics for personal e-book libraries, written as Spark DataFrame plans."""
