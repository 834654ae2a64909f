"""rankshift: Spark-native corpus preparation and ranking-robustness evaluation.

Every operator is a function ``DataFrame -> DataFrame`` (chain them with
``df.transform``); nothing here holds data or collects unbounded results.
"""

__version__ = "0.1.0"
