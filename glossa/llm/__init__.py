"""Operators for preparing training corpora, each over whole DataFrames of documents."""
