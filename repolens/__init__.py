"""repolens: source-repository analytics as PySpark DataFrame jobs."""
