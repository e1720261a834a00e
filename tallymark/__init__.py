"""Statistical modelling of count, continuous and binary targets as Spark jobs."""
