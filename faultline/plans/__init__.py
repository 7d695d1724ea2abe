"""Failure-output analytics on Sparkplans."""
