"""logweir: log anomaly analytics as plain PySpark DataFrame functions."""
