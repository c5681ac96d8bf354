"""attestra: citation verification and corpus preparation on PySpark."""
