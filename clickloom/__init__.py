"""Behaviour analytics on PySpark."""
