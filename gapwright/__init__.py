"""Gap analytics for daily sensor series on Spark."""
