"""Document-collection and event-store analytics expressed as Spark DataFrame plans."""
