"""Star-schema analytics on PySpark: sources, operators, a relational plan format, and the benchmark's queries."""
