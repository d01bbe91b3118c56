"""Comparison of a DataFrame with a DuckDB relation."""


def plain(value):
    """A value that compares equal across both engines."""
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def agree(df, relation):
    """Whether a DataFrame and a DuckDB relation have the same columns and rows."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(str([plain(r[i]) for i in at]) for r in relation.fetchall())
    assert ours == theirs
