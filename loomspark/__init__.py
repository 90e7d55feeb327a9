"""loomspark: a Spark-first engine for knowledge-graph and corpus analytics."""
