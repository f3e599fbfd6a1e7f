"""Hooks, layouts, typed rows and the writer's lock: the surface that runs on the driver."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame

from cairn.operators import mutations


def hook_environment(volume: str, path: str, trigger: str, run_id: int, changed: int) -> dict[str, str]:
    """X2"""
    return {"CAIRN_VOLUME": volume, "CAIRN_PATH": path, "CAIRN_TRIGGER": trigger, "CAIRN_RUN": str(run_id), "CAIRN_CHANGED": str(changed)}


@dataclass
class Outcome:
    status: str
    exit_code: int | None = None
    error: str | None = None


def run_hook(command: list[str], env: dict[str, str], timeout_s: float) -> Outcome:
    """A configured command with its fields in the environment, ended after its time."""
    try:
        done = subprocess.run(command, env=os.environ | env, timeout=timeout_s, capture_output=True, text=True)
    except subprocess.TimeoutExpired:
        return Outcome("timeout", None, f"timed out after {timeout_s:g} s")
    return Outcome("success" if done.returncode == 0 else "failed", done.returncode, done.stderr.strip() or None)


def typed(rows: DataFrame, kind: Callable[..., Any]) -> Iterator[Any]:
    """Rows of a bounded result as objects, streamed partition by partition."""
    for r in rows.toLocalIterator():
        yield kind(**r.asDict())


class Layout(Protocol):
    """What a destination layout brings to a push."""

    def reconcile(self, paths: DataFrame) -> DataFrame: ...

    def watermark(self) -> int: ...

    def delta(self, since: int) -> DataFrame: ...

    def translate(self, delta: DataFrame) -> DataFrame: ...

    def execute(self, ops: DataFrame) -> DataFrame: ...

    def seal(self, done: DataFrame) -> None: ...


def push(layout: Layout, paths: DataFrame, vectors: DataFrame, maxima: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settle, plan, translate, execute, seal, advance. `maxima` was settled before the delta is read."""
    settled = layout.reconcile(paths)
    done = layout.execute(layout.translate(layout.delta(layout.watermark())))
    layout.seal(done)
    return settled, mutations.advance_vector(vectors, maxima)[0]


@contextmanager
def exclusive(path: str):
    """One writer: a lock file that only one process can make."""
    fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        yield
    finally:
        os.close(fd)
        os.unlink(path)
