"""Operators of a training-data pipeline over a table of documents.

Each module holds one operator and its method; ``queries`` registers one query per
operator, ``oracle`` the DuckDB SQL of those that SQL can express. Nothing outside this
package (but ``__spark_entry__`` and ``corpus_pipeline``) imports it.
"""
