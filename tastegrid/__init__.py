"""Tastegrid: preference and edit-parameter analytics on PySpark."""
