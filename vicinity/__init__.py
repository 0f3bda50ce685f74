"""vicinity: retrieval-based text classification as Spark jobs.

Labelled corpora are prepared, encoded to vectors, indexed as ordinary tables,
searched with top-k similarity joins, classified by neighbour vote or ML-kNN,
mined for training tuples and scored - every step a DataFrame transformation.

Sub-packages
------------
sources     readers and writers (JSON lines, label names, datasets, index / model tables)
functions   Column expressions (hash uniforms, vector math, tokenizer, sentence splitter)
operators   DataFrame -> DataFrame operators (corpus prep, kNN joins, IVF, MaxSim,
            vote, ML-kNN, sampling, metrics, explanation, MLlib wrappers)
plans       the query catalogue: one function per registered query plus its oracle SQL
streaming   incremental metric counters over a file stream
"""

from vicinity.session import checkpoint_dir, cut_lineage, get_spark, ship_package  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage", "ship_package"]
