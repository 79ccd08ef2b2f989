"""One assessment as a list of stages: each stage is one result table, written when its inputs are complete."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..sources.stores import write_result

_DONE = ("completed", "completed_with_warnings")
STATUS_SCHEMA = "assessment_id string, engine string, status string, started_at string, completed_at string, result_path string, reason string"


@dataclass(frozen=True)
class Stage:
    engine: str
    build: Callable[[dict[str, str]], DataFrame]
    needs: tuple[str, ...] = field(default=())
    enabled: bool = True


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def run_stages(spark: SparkSession, assessment_id: str, stages: list[Stage], root: str) -> DataFrame:
    """Run stages in order and give their status table.

    A stage whose input did not complete is `unavailable`, a disabled one `not_assessed`; an error in one
    stage does not stop the others. `build` receives the paths of the written results, so a lost
    executor or session never repeats a finished stage.
    """
    status, paths, rows = {}, {}, []
    for stage in stages:
        started, reason, path = None, None, None
        failed = [n for n in stage.needs if status.get(n) not in _DONE]
        if failed:
            status[stage.engine], reason = "unavailable", f"required stage did not complete: {', '.join(failed)}"
        elif not stage.enabled:
            status[stage.engine], reason = "not_assessed", "disabled in the configuration"
        else:
            started = _now()
            try:
                path = write_result(stage.build(paths), root, assessment_id, stage.engine, fmt="parquet")
                paths[stage.engine], status[stage.engine] = path, "completed"
            except Exception as error:  # the record keeps the reason, later stages see the state
                status[stage.engine], reason = "error", f"{type(error).__name__}: {error}"
        rows.append((assessment_id, stage.engine, status[stage.engine], started, _now(), path, reason))
    return spark.createDataFrame(rows, STATUS_SCHEMA)
