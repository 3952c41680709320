"""Literature evidence analytics on Spark."""
