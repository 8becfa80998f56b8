"""millrace: streaming-style ETL pipelines and analytics expressed as PySpark DataFrame plans."""
