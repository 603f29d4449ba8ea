"""Streams: scoring with a fitted system and windowed monitoring. An extension; batch queries have the same results."""
