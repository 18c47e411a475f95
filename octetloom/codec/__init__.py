"""Decoders and encoders in plain Python, usable without Spark."""
