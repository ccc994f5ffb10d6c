"""Training-data operators: archives, decontamination, deduplication, token output, packing and quality.

Nothing else in the library imports this subpackage.
"""
