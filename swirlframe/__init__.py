"""Swirlframe: image-based flow analysis as DataFrame operators on Spark."""

from __future__ import annotations


def attach(spark):
    """Python workers on this machine find the package even where it isn't installed or on PYTHONPATH; returns ``spark``.

    On a cluster the package is installed on the executors or shipped with ``--py-files``.
    """
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark
