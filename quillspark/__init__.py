"""A batch retrieval and evaluation engine on Spark DataFrames, with training-data operators beside it."""

import os


def ship(spark) -> None:
    """Let Python workers on this machine import the package, wherever the session was started from."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
