"""Training-data operators: dedup, extraction, scoring, mixing, packing, token files.

Nothing outside this package imports it. The Python kernels run on executors,
so the package must be importable there (``--py-files`` or an installed wheel).
"""
