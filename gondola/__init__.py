"""gondola: retail price and shelf analytics on Spark."""
