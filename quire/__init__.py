"""quire: document analytics on PySpark."""
