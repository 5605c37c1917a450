"""Requests as a stream."""
