"""All queries of the core library and their SQL twins."""

from quillon.plans import flows, legal, relational, retrieval, texts, training

MODULES = (training, retrieval, texts, relational, legal, flows)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
