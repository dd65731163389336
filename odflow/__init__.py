"""Origin-destination demand analytics and forecasting as Spark jobs."""
