"""Document-set reconciliation and analytics on PySpark."""
