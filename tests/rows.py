def plain(df):
    """Rows of a pandas frame as sorted tuples of plain values, columns by name."""
    import numpy as np
    import pandas as pd

    def value(x):
        if x is None or x is pd.NA or isinstance(x, float) and np.isnan(x):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (int, np.integer)):
            return int(x)
        return float(x) if isinstance(x, (float, np.floating)) else x

    cols = [[value(x) for x in df[c].tolist()] for c in sorted(df.columns)]
    return sorted(zip(*cols, strict=True), key=repr)
