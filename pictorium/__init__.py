"""Photo and face catalogue analytics, expressed as Spark DataFrame plans."""
