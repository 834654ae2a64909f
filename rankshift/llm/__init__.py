"""Training-data operators (top-k search, mixing, dedup, decontamination, scans, classifiers).

Nothing else in the library imports this subpackage.  Every operator takes
and returns DataFrames; the thin ``opN_`` queries live in ``queries.py``.
"""
