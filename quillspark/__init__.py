"""Spark-native OCR text alignment, correction evaluation and error analytics."""
