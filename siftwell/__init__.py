"""Set-based PySpark operators for retrieval data quality and analytics."""
