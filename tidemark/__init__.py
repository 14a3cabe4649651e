"""Analytics over time-stamped user-item behaviour logs, and training-data operators, on Spark."""
