"""Curation of labelled and unlabelled datasets as Spark DataFrame jobs."""
