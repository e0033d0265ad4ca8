"""Part of treeflow."""
