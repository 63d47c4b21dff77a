"""Operations of a training-data pipeline. Nothing outside this package, its tests and ``corpus_pipeline.py`` imports it."""
