"""Column functions: text and name normalisation, settings, small classifiers of values."""
