"""Live monitors of training metrics."""
