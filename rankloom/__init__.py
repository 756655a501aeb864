"""Learning-to-rank analytics on search logs, written as Spark DataFrame jobs."""
