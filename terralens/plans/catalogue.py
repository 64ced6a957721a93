"""All registered queries, by topic."""

from __future__ import annotations

from . import dialogue, files, graph, media, space, vectors

TOPICS = (vectors, graph, space, media, dialogue, files)

QUERIES = {key: fn for topic in TOPICS for key, fn in topic.CAT.queries.items()}
SQL = {key: sql for topic in TOPICS for key, sql in topic.CAT.sql.items()}
