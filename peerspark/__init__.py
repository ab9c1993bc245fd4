"""peerspark: peer-recommendation analytics expressed as Spark DataFrame jobs."""
