"""Column expressions and the fixed reference data behind them."""
