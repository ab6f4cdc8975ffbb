"""Training-data operators: mixing, scans, quality, tokens, packing, near-duplicates, archives.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
