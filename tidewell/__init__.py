"""tidewell: batch and change-data ingestion expressed as Spark DataFrame plans."""
