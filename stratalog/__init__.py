"""Turn raw log lines into structured events and score windows of them, on Spark."""

import importlib

#: Public names and their modules; imported when asked for, so that a task that needs one
#: module does not load all.
_EXPORTS = {
    "PipelineConfig": "config", "load_config": "config", "save_config": "config", "BatchPipeline": "plans.pipeline",
    "compare_strategies": "plans.pipeline", "ChunkPipeline": "streaming.pipeline", "ChunkState": "streaming.pipeline",
    "load_dataset": "sources.readers", "read_results": "sources.readers",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_EXPORTS[name]}"), name)
