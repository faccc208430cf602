"""spatialscore: spatial prediction scoring and areal aggregation as Spark jobs."""
