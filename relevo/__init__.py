"""relevo: product-search relevance as Spark DataFrame / SQL / MLlib jobs.

Sub-packages
------------
functions   Column -> Column text cleaning and pairwise similarity expressions
sources     table readers, fixture derivations, CSV / text / parquet / JSON I/O
operators   relational building blocks: catalog assembly, profiling, BM25,
            spelling correction, TF-IDF and vector features, model fitting
plans       end-to-end jobs composed from operators (batch search, catalog build)
streaming   the search plan over a stream of incoming queries
"""

from relevo.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
