"""Agent-activity analytics and training-data operators as Spark DataFrame jobs."""
