"""Validation of thermospheric density models against satellite observations, as Spark plans."""
