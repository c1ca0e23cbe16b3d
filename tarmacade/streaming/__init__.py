"""Structured Streaming jobs and the stateful folds they share with batch."""
