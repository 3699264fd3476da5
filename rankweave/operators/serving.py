"""One request through a registered retriever: the same code that ranks a log, on a log of one impression."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import metrics
from .experiments import RETRIEVERS


@dataclass
class Ranker:
    """Holds a retriever's tables (vectors, articles, counts) and ranks candidates for a click history.

    ``types``: Spark type of article ids. ``timings`` has the milliseconds of the last request's stages. A request is
    a few hundred ids at most; only its ranked candidates come to the driver."""

    spark: object
    name: str
    tables: dict
    types: str = "string"
    timings: dict[str, float] = field(default_factory=dict)

    def _request(self, history: list, candidates: list) -> dict:
        log = self.spark.createDataFrame([(0, c, i, 0) for i, c in enumerate(candidates)], f"impression_id long, article_id {self.types}, pos int, label int")
        clicks = [(0, a, age, len(history)) for age, a in enumerate(reversed(history))]
        window = self.spark.createDataFrame(clicks, f"impression_id long, article_id {self.types}, age int, n_clicks int")
        return self.tables | {"log": log, "window": window}

    def scored(self, history: list, candidates: list) -> DataFrame:
        """impression_id, article_id, pos, label, score, rank of the request's candidates."""
        return metrics.rank(RETRIEVERS[self.name](self._request(history, candidates)))

    def rank(self, history: list, candidates: list) -> list[tuple[object, float]]:
        """(candidate, score), best first, ties in order of arrival. ``history`` is oldest first."""
        if not candidates:
            return []
        at = [time.perf_counter()]
        ctx = self._request(history, candidates)
        at.append(time.perf_counter())
        scored = RETRIEVERS[self.name](ctx)
        at.append(time.perf_counter())
        rows = metrics.rank(scored).select("article_id", "score", "rank").collect()
        at.append(time.perf_counter())
        out = [(r.article_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])]
        at.append(time.perf_counter())
        self.timings = {n: 1000 * (b - a) for n, a, b in zip(("request", "plan", "score", "answer"), at, at[1:])}
        return out
