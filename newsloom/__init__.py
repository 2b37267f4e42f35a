"""newsloom: news intelligence and corpus preparation as Spark DataFrame jobs."""
