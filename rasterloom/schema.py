"""Table schemas of the data model."""

from pyspark.sql import types as T

from rasterloom import config as cfg

_i, _l, _d, _s, _t = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.TimestampType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_bands = {b: _i for b in cfg.BANDS}
PIXELS = _table(year=_i, row=_i, col=_i, **_bands)
OBSERVATIONS = _table(scene_id=_s, ts=_t, row=_i, col=_i, scl=_i, **_bands)
SCENES = _table(scene_id=_s, ts=_t, cloud_pct=_d, crs=_s, xmin=_d, ymin=_d, xmax=_d, ymax=_d)
CLOUD = _table(year=_i, row=_i, col=_i, flag=_i)
LABELS = _table(row=_i, col=_i, wc=_i)
CLASSIFIED = T.StructType(_table(year=_i, row=_i, col=_i).fields + [T.StructField("class", _i)])
POINT = _table(x=_d, y=_d)
GEOJSON_FEATURES = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.MapType(_s, _s)),
        T.StructField("geometry", T.StructType([T.StructField("type", _s), T.StructField("coordinates", _s)])),
    ]))),
])
