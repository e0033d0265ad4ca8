"""treeflow: discover and reconcile two hierarchical trees with Spark DataFrames."""

__version__ = "0.1.0"
