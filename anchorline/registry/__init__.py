"""All registered queries and their SQL counterparts."""


def _loaded():
    from anchorline.registry import files, operators, studies  # noqa: F401  (registers on import)

    return operators


def all_queries():
    return dict(_loaded().QUERIES)


def all_sql():
    return dict(_loaded().SQL)
