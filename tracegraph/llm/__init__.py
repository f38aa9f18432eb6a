"""Operators for building training corpora, each on plain DataFrames.

Conventions shared by all of them: only the named input columns are read (other
columns, whatever their names, are ignored); a null text is an empty text; rows
whose key column is null cannot be named in a result and are left out unless the
operator says otherwise; an empty input gives an empty result of the same schema.
"""
