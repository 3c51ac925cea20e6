"""Analytics for daily item panels: stock curves, item features, targets and day distributions on Spark."""
