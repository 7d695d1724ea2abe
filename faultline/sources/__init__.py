"""Failure-output analytics on Sparksources."""
