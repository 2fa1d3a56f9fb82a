"""Relational operators over detections, pairs and tracks."""
