"""vitalframe: measurement-series analytics as Spark DataFrame transforms."""
