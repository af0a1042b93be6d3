"""Small rasters as tables and back."""

import numpy as np


def table(spark, array, name="v", **layers):
    """2-D numpy array to a pixel table."""
    h, w = array.shape
    rows = [(int(r), int(c), array[r, c].item()) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, ["row", "col", name]).selectExpr("int(row) row", "int(col) col", name)


def array(df, name, shape, fill=np.nan):
    out = np.full(shape, fill, dtype=float)
    for r in df.select("row", "col", name).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out
