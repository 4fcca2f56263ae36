"""driftsonde: hybrid retrieval, ranking and feedback analytics as Spark DataFrame plans."""
