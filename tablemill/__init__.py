"""Corpus-scale file inspection, conversion and checking on PySpark."""
