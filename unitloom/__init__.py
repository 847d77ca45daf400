"""Code-unit indexing, upkeep and hybrid search as PySpark DataFrame jobs."""
