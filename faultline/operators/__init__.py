"""Failure-output analytics on Sparkoperators."""
