"""Private linear-query answering on Spark: histograms, marginals, budgeted Gaussian mechanisms and their exact error."""
