"""Relevance search over tables of documents, expressed as Spark DataFrames.

Sub-packages
------------
functions   Column -> Column text and markup expressions
operators   DataFrame -> DataFrame steps: postings, statistics, ranking, upserts
sources     reading documents and reading/writing the index tables
streaming   incremental feeds on Structured Streaming
plans       session settings, size checks and scratch storage
"""

from textlode.index import TermIndex
from textlode.operators.analysis import Analyzer

__all__ = ["Analyzer", "TermIndex"]
