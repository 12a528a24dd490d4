"""Operators over tables of nodes."""
