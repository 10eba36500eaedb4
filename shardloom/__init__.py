"""Spark-native preshuffling, minibatch sampling and data preparation.

Nothing in this package imports ``shardloom.llm``; that subpackage is optional.
"""

__version__ = "0.1.0"
