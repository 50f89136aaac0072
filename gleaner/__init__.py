"""Spark jobs that triage trees of script files and prepare text corpora."""
