import pandas as pd


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if hasattr(x, "tolist"):
        x = x.tolist()
    # A column of whole numbers with nulls comes as floats from one side and as integers from the other.
    return repr(int(x)) if isinstance(x, float) and x.is_integer() else repr(float(x)) if isinstance(x, float) else repr(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
