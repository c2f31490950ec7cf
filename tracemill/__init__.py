"""Log analytics and log-anomaly detection as Spark jobs."""
