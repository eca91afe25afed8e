"""segloom: parallel-text (localisation) analytics as Spark DataFrame jobs."""
