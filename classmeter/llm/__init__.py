"""Operators of a training-data pipeline, each built by one stated method."""
