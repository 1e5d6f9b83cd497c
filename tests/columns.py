"""Reading columns of results."""


def column(df, name, key="row_id"):
    """Values of a column in key order."""
    return [r[name] for r in df.orderBy(key).collect()]
