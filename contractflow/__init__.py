"""Contract-checked ingestion and change capture for PySpark DataFrames."""
