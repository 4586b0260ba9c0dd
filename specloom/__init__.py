"""specloom: higher-order spectral analysis of sampled signals on Spark DataFrames."""
