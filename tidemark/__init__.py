"""Analytics over archived measurement series, as Spark plans over many series at once."""
