"""Analytics over electric networks, and the relational operators behind them, as PySpark DataFrames."""
