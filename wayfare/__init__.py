"""Transit-access analytics on PySpark."""
