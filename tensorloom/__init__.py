"""tensorloom: tensors, object graphs and model data as lazy Spark DataFrames."""

__version__ = "0.1.0"
