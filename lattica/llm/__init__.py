"""Operators of a training-data pipeline over text; nothing else in lattica imports this."""
