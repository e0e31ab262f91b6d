"""Operators on contact maps, windows, detections and call lists."""
