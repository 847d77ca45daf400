"""Collects the registered queries and their SQL."""

QUERIES = {}
SQL = {}


def check(name, statement=None):
    def add(fn):
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn

    return add
