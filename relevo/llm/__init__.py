"""Training-data pipeline operators. Nothing outside this subpackage imports it, except the guarded
registration in ``__spark_entry__.py`` and ``corpus_pipeline.py``."""
