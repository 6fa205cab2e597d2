"""Streams: the batch windows over unbounded input."""
