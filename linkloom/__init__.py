"""Content and link analytics on PySpark."""
