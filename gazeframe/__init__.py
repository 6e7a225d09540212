"""gazeframe: a Spark-native analytics engine for eye-tracking recordings."""

from gazeframe.frame import GazeFrame, RecordingMeta
from gazeframe.functions.aoi import AOI, Circle, Ellipse, Polygon, Rect

__all__ = ["AOI", "Circle", "Ellipse", "GazeFrame", "Polygon", "Rect", "RecordingMeta", "read"]


def read(spark, path, **options):
    """Recordings of any supported format as a :class:`GazeFrame`; see :func:`gazeframe.sources.read.read`."""
    from gazeframe.sources.read import read as _read

    return _read(spark, path, **options)
