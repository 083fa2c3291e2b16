"""Replay: every state is derived from the untouched source by the recorded pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from scour.plans.pipeline import apply_pipeline
from scour.sources.staging import stage

Pipeline = Sequence[Mapping]


def replay(
    source: DataFrame,
    pipelines: Sequence[Pipeline],
    upto: int | None = None,
    row_id: str = "row_id",
    stage_every: int | None = None,
) -> DataFrame:
    """The state after the first `upto` pipelines (all by default; 0 is the source).

    Long histories make long plans. `stage_every` writes the state to the shared folder whenever
    that many steps have piled up (about 20 is a good number) and goes on from there.
    """
    state, pending = source, 0
    for steps in pipelines[:upto]:
        if stage_every is not None and pending and pending + len(steps) > stage_every:
            state, pending = stage(state, "replay"), 0
        state = apply_pipeline(state, steps, row_id)
        pending += len(steps)
    return state


def record(
    source: DataFrame,
    pipelines: Sequence[Pipeline],
    steps: Pipeline,
    row_id: str = "row_id",
) -> list[Pipeline]:
    """The history with one more pipeline, if it fits the current state.

    The check is an analysis of the plan: unknown columns raise ValueError and operators that do
    not fit a column's type raise TypeError before any data is read.
    """
    state = replay(source, pipelines, row_id=row_id)
    apply_pipeline(state, steps, row_id).schema  # noqa: B018 - forces the analysis
    return [*pipelines, list(steps)]
