"""Oscillator-state analytics on Spark."""
