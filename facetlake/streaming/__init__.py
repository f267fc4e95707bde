"""Batch documents as a stream: shredded as they arrive, counted per window of arrival."""
