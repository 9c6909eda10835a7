"""Operators of a training-data pipeline. Nothing else in tidegauge imports this subpackage."""
