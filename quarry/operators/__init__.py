"""DataFrame-in, DataFrame-out analysis operators."""
