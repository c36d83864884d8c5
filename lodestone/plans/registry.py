"""All queries of the core by name, and their SQL where SQL can express them."""

from lodestone.plans import corpus_queries, memory_queries, search_queries, intake_queries

_modules = (search_queries, corpus_queries, intake_queries, memory_queries)
QUERIES = {name: f for m in _modules for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _modules for name, sql in m.SQL.items()}
