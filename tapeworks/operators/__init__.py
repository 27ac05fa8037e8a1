"""DataFrame operators: bars, indicators, rules, trades, validation."""
