"""Operators of a training-data pipeline; each module holds one, with its query and its SQL."""
