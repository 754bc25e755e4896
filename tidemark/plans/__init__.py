"""Whole jobs, and the operators over the driver's tables."""
