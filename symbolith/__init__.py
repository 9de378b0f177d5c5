"""Analytics over code definitions, and data preparation, as Spark DataFrame operators."""
