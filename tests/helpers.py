"""What several test modules use."""

SMALL = "/root/testdata/sf0.001"


def rows(df, *order):
    """Rows as plain tuples, sorted."""
    picked = df.select(*order) if order else df
    return sorted([tuple(r) for r in picked.collect()], key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
