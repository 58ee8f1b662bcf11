"""Training-data operators: quality rules, mixing, packing, WARC bundles, secret
scans, exact / substring / near dedup, language ID and a quality classifier.

Nothing else in the library imports this subpackage.
"""
