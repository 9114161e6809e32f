"""Plans of DataFrames, for tests that look at what Spark will run."""


def plan_of(df) -> str:
    """The physical plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()
