"""Column lineage, impact analysis and corpus preparation as Spark jobs."""
