"""spanlake: storage and queries for trace-shaped records on PySpark."""
