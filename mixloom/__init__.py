"""mixloom: Bayesian clustering and data-quality analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
