"""Failure-output analytics expressed as Spark DataFrame transformations."""
