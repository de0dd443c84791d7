"""Analytics over anchored code knowledge, written as Spark plans."""
