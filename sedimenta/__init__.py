"""Corpus audit on Spark: per-document signals and corpus summaries as DataFrame plans."""
