"""Data-quality, drift and evaluation operators for multiclass text
classification, written as Spark DataFrame programs."""

from .datasets import DatasetSet

__all__ = ["DatasetSet"]
