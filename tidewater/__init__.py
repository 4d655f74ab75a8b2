"""At-least-once event processing and analytics on PySpark."""
