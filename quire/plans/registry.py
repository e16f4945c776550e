"""Named queries over the test tables, each with SQL that gives the same rows where SQL can."""

from quire.plans import field_queries, layout_queries, monitor_queries, page_queries, stream_queries, text_queries

_MODULES = [text_queries, monitor_queries, page_queries, field_queries, layout_queries, stream_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
