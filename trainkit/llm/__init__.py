"""Training-data operators for text corpora: one module per operator, `queries` registers them."""
