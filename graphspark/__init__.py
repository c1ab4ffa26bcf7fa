"""Analytics over collections of small graphs and the text written about them, on Spark."""
