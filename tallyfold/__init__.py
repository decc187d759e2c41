"""Analytics over experiment ledgers and training data on Spark."""
