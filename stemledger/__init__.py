"""Spark-native preparation of forest-inventory tables into paired-census datasets."""

from stemledger.schema import CensusType, DbhUnit

__all__ = ["CensusType", "DbhUnit"]
__version__ = "0.1.0"
