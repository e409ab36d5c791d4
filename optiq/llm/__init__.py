"""Operators of a training-data pipeline: tokenizing, archives, chat windows,
near duplicates, language, quality, repeated passages and mixtures.

Each module holds one operator with a general interface and the thin query
that registers it; ``queries.py`` lists the queries and their DuckDB SQL.
Nothing outside this subpackage imports it.
"""
