"""Corpus analytics on PySpark: routing, cleaning, blending, scoring, comparing."""
