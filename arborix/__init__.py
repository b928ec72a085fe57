"""arborix: code-graph and corpus analytics as Spark jobs."""
