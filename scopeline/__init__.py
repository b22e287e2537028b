"""Spark-native analytics over video recordings, frames, masks and detections."""

__version__ = "0.1.0"
