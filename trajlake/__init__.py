"""trajlake: driving-trajectory analytics expressed as PySpark DataFrame jobs."""
