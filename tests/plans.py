"""Executed plans as text."""


def final_plan(df):
    """The executed plan as text, without the repeated initial plans."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
