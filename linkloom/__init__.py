"""Spark-native URL-corpus engine: discovery, canonicalization, verification and diffing as DataFrame plans."""
