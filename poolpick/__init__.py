"""poolpick: Spark-native selection of rows to annotate from a multilingual pool.

Subpackages
-----------
functions   Column builders and numpy block kernels (scores, vectors, text)
operators   DataFrame operators (prepare, chunking, embeddings, uncertainty,
            neighbours, strategies, metrics, reports, languages)
sources     readers and writers (CSV/TSV/JSON/Parquet, run trees, sinks)
plans       multi-round / multi-budget drivers and the named query catalogue
streaming   none needed (the selection rounds are bounded batch jobs)
"""

__version__ = "0.1.0"
