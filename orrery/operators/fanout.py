"""Searches of many repositories side by side within a time budget: what has ended counts, the rest is cancelled and told."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.repo import intent_hits
from orrery.sources.shared import Saved

#: Hits of one repository in a search over all of them, and that search's budget in seconds.
ENTITY_HITS, CONTENT_HITS, BUDGET = 24, 24, 5.0
#: Searches that run side by side at most; their jobs share the cluster by Spark's own scheduling.
SIDE_BY_SIDE = 4


@dataclass(frozen=True)
class FanOut:
    """What ended in time, as saved tables; what did not, and what failed with its error."""

    done: dict[str, DataFrame]
    pending: tuple[str, ...]
    failed: dict[str, str]

    @property
    def partial(self) -> bool:
        return bool(self.pending or self.failed)


def normalized(seed: str) -> str:
    """A repository's name as a query may write it: lower case, ``_ . / -`` and spaces alike, without ``.jl`` at its end."""
    low = seed.strip().lower().removesuffix(".jl")
    return " ".join(re.sub(r"[_./\s-]+", " ", low).split())


def repo_hint(query: str, repos: Sequence[str]) -> str | None:
    """The one repository whose name the query is; none if no name fits or several do."""
    wanted = normalized(query)
    found = [r for r in repos if wanted and normalized(r) == wanted]
    return found[0] if len(found) == 1 else None


def fan_out(spark: SparkSession, searches: dict[str, Callable[[], DataFrame]], seconds: float | None, side_by_side: int = SIDE_BY_SIDE) -> FanOut:
    """Run each search and save its rows, ``side_by_side`` at a time, in their order; at the deadline all jobs still running are cancelled.

    A search is cut to its top hits by its maker, and is one Spark action under a tag of its own; a result counts once
    it is written whole.  Without ``seconds`` all are waited for.
    """
    saved, run = Saved(spark, "fan-out"), f"fan-out-{uuid.uuid4().hex[:8]}"
    deadline = None if seconds is None else time.monotonic() + seconds
    over = threading.Event()

    def one(name: str) -> DataFrame | None:
        if over.is_set():
            return None
        spark.sparkContext.addJobTag(run)
        try:
            return saved.keep(searches[name](), re.sub(r"\W", "-", name))
        finally:
            spark.sparkContext.removeJobTag(run)

    done: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    with ThreadPoolExecutor(max(1, min(side_by_side, len(searches) or 1))) as pool:
        left = {pool.submit(one, name): name for name in searches}
        while left:
            rest = None if deadline is None else max(0.0, deadline - time.monotonic())
            ended, _ = wait(left, timeout=rest, return_when=FIRST_COMPLETED)
            for f in ended:
                name = left.pop(f)
                if error := f.exception():
                    failed[name] = f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"
                else:
                    done[name] = f.result()
            if left and deadline is not None and time.monotonic() >= deadline:
                over.set()
                for f in left:
                    f.cancel()
                spark.sparkContext.cancelJobsWithTag(run)
                break
    return FanOut({n: done[n] for n in searches if n in done}, tuple(n for n in searches if n not in done and n not in failed), failed)


def code_search(spark: SparkSession, query: str, sources: dict[str, Callable[[str, int], DataFrame]], limit: int, seconds: float | None = BUDGET, side_by_side: int = SIDE_BY_SIDE) -> DataFrame:
    """(source, id, path, score, pending, skipped, partial): the best hits of a query over all repositories.

    ``sources`` makes a repository's hits (id, path, score) from the query and a limit.  A query that names one
    repository searches that alone, with the whole limit and no budget; the others are skipped.  Otherwise each gives
    ``CONTENT_HITS`` at most, within the budget.  ``pending`` are those cut off by it, ``skipped`` those left out or failed.
    """
    hint = repo_hint(query, list(sources))
    asked = [hint] if hint else list(sources)
    each = limit if hint else min(limit, CONTENT_HITS)
    got = fan_out(spark, {n: (lambda n=n: sources[n](query, each)) for n in asked}, None if hint else seconds, side_by_side)
    skipped = [n for n in sources if n not in asked] + list(got.failed)
    if not got.done:
        none = spark.createDataFrame([], "id string, path string, score double")
        return intent_hits({"": none}, limit, got.pending, skipped)
    return intent_hits(got.done, limit, got.pending, skipped)
