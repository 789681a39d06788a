"""touchline: match and event analytics as Spark DataFrame jobs."""
