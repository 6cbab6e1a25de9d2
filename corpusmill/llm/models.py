"""Fitted models kept in the shared folder, so that two queries over the same tables fit once.

A model is stored under the files it was fitted on and the application; frames that read no files are fitted anew each time. A query that
measures a model's cost asks for a fresh fit, which replaces what is stored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from corpusmill.session import shared_dir


def _place(spark: SparkSession, name: str, inputs: list[DataFrame], *settings: Any) -> str | None:
    files = [sorted(df.inputFiles()) for df in inputs]
    if not all(files):
        return None
    mark = hashlib.sha1(repr((spark.sparkContext.applicationId, files, settings)).encode()).hexdigest()
    return f"{shared_dir(spark).rstrip('/')}/models/{name}-{mark}"


def fitted(name: str, inputs: list[DataFrame], build: Callable[[], Any], *settings: Any, fresh: bool = True) -> Any:
    """What `build` gives (a bounded model), stored for later calls; a stored one is used unless `fresh`."""
    spark = inputs[0].sparkSession
    place = _place(spark, name, inputs, *settings)
    if place and not fresh:
        try:
            return pickle.loads(spark.read.schema("model binary").parquet(place).first()[0])  # written by this application
        except (AnalysisException, TypeError):
            pass
    model = build()
    if place:
        spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(place)
    return model
