"""Failure-output analytics on Sparkfunctions."""
