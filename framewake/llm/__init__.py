"""Ten operators for corpora of training data. Nothing outside this package imports it."""
