"""Spark-first analytics for multichannel gaze recordings and biometric verification."""
