"""docmill: document analytics on PySpark."""
