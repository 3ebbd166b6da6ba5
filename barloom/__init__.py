"""Bar-structured time series on Spark: bars, indicators, signals, order replay, ledgers and reports."""
