"""Analytics over the telemetry and training traces of machine-learning jobs, on Spark."""
