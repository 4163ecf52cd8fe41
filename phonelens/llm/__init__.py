"""Training-data operators: de-duplication, sharding, quality, scoring,
token counts, decontamination, packing and license scans.

Nothing else in the library imports this package; ``queries`` holds the
registered queries and their SQL.
"""
