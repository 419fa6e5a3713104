"""marketlab: DataFrame and Structured Streaming operators for market and trading data."""
