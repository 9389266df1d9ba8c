"""Waymark: a secondary-index layer for large append-only tables, on DataFrames only.

An index is an ordinary bucketed and sorted table ``keys -> row locator``. It is built per
partition, can be queried like any table, and brings back payload columns by seeking to rows.
"""

from waymark.manager import IndexManager
from waymark.operators.kv import KVFile, KVFolder, KVOptions, KVWriter, write_kv, write_partitioned_kv
from waymark.sources.indexer import TableIndexer
from waymark.spec import IndexSpec, ReaderOptions, WriterOptions

__all__ = ["IndexManager", "IndexSpec", "KVFile", "KVFolder", "KVOptions", "KVWriter", "ReaderOptions", "TableIndexer", "WriterOptions", "write_kv", "write_partitioned_kv"]
