"""tidegate: change-safety analytics over tables, query logs and text, as Spark jobs."""
