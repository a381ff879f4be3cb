"""Helpers of these tests."""


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
