"""Timeline analytics on PySpark: operators over timestamped, nested and binary records."""
