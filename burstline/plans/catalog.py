"""The registered queries and the SQL that states them."""

from . import detect, evaluation, language, raw, streams, texts, vectors

PARTS = (detect, texts, evaluation, vectors, language, raw, streams)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in PARTS for k, v in part.SQL.items()}
