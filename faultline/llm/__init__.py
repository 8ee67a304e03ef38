"""Operators for training-data pipelines: archives, token counts, quality, duplicates, personal data, packing.

Nothing else in the library imports this subpackage. Tasks get these modules by value (see the parent package), so
executors need no installed copy.
"""
