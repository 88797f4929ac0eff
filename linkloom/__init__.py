"""linkloom: a PySpark-native engine for mining hyperlinked document collections."""

from .session import cut, get_spark, table

__all__ = ["cut", "get_spark", "table"]
