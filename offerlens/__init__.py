"""offerlens: offer-price analytics as PySpark DataFrame jobs."""
