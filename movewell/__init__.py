"""Sport-activity analytics on Spark: change capture, benefit eligibility, data quality."""
