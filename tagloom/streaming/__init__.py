"""Recommendations for questions that arrive as a stream."""
