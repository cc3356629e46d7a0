"""Analytics operators for versioned web-content catalogues, on Spark."""
