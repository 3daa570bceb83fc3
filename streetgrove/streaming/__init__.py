"""Structured Streaming jobs of the edit journal and the run log."""
