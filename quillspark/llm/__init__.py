"""Operators of a training-data pipeline; each module holds one operator. Nothing else in the library imports this subpackage."""
