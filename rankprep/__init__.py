"""PySpark jobs for learning and evaluating models with very large output spaces."""
