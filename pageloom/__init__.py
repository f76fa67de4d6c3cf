"""pageloom: web-corpus data work as Spark DataFrames.

Page snapshots, link tables and fetch logs come in as DataFrames or streams;
link extraction, breadth-first traversal, text extraction, chunking,
deduplication, fetch-health analysis and export come out as DataFrames.
"""

__version__ = "0.1.0"
