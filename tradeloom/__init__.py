"""Trade-document analytics expressed as Spark DataFrame pipelines."""
