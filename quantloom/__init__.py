"""quantloom: a DataFrame-first analytics engine for quantitative proteomics on Spark."""

__version__ = "0.1.0"
