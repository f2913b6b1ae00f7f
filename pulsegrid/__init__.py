"""Population health-risk analytics on PySpark."""
