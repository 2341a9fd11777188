"""Analytics over coding-session data as Spark DataFrames."""
