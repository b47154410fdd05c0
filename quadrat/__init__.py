"""quadrat: panel analytics and data preparation for monitoring data on Spark."""
