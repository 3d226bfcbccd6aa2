"""All queries, each over whole tables, with the SQL that gives the same rows."""

from textmap.catalog import maps, models, publish, streams, summaries, text, web

_PARTS = (text, web, maps, summaries, publish, models, streams)


def queries() -> dict:
    return {name: run for part in _PARTS for name, run in part.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
