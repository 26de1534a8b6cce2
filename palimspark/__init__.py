"""Analytics over versioned document collections, written as Spark DataFrames."""
