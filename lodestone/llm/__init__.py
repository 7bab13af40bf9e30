"""Operators of a training-data pipeline: filters, deduplication, encoding, archives.

Nothing outside this subpackage imports it. On a cluster the package must be on
the executors' Python path (``--py-files`` or an installed wheel).
"""
