"""What several tests of the engine use."""


def rows(df):
    """Rows as plain tuples, in order, of any types."""
    def plain(x):
        return tuple(plain(v) for v in x) if isinstance(x, (list, tuple)) else x

    return sorted((plain(r) for r in df.collect()), key=repr)
