"""Order-flow analytics as ordinary Spark DataFrame jobs."""
