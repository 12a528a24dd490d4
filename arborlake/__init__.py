"""Disk-usage analytics over flat tables of file-system nodes, on PySpark."""
