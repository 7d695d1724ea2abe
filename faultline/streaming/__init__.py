"""Failure-output analytics on Sparkstreaming."""
