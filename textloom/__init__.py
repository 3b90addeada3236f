"""Text analytics for Korean and mixed-language corpora on PySpark."""
