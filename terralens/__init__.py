"""Earth-observation catalogue, knowledge-graph and retrieval work as Spark DataFrame jobs."""
