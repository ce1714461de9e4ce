"""vigil: LLM request governance analytics on Spark."""

# Python folds (mapInPandas / applyInPandasWithState) reference functions of
# this package. Pickling the package by value ships that code to the Python
# workers with each task, so executors need no installed copy or path setup.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
