"""Review, catalogue and traffic analytics as DataFrame-to-DataFrame functions on Spark."""
