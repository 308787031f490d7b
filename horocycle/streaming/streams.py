"""Structured Streaming forms of the operators: stateless ones as they are, stateful ones by key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from horocycle.functions.constants import KAPPA, KAPPA_FUNCTIONAL, KAPPA_PHYLOGENETIC, TOP_K
from horocycle.operators import calibration as C
from horocycle.operators import hplg, placement
from horocycle.operators.chimera import chimera_scores
from horocycle.operators.knn import geodesic_knn
from horocycle.sources import writers


def place_stream(queries: DataFrame, prototypes: DataFrame, k: int = TOP_K, kappa: float = KAPPA) -> DataFrame:
    """Ranked neighbours of a stream of ``(qid, embedding)``; no state, so it runs in append mode."""
    return geodesic_knn(queries, prototypes, k, kappa)


def placement_sink(path: str, prototypes: DataFrame, scores: DataFrame, k: int = TOP_K, kappa: float = KAPPA):
    """A foreachBatch function that places the ``(qid, embedding)`` of a batch and writes report rows with scores and zones as TSV.

    A batch's folder carries its number and is written anew if the batch comes again, so a restarted stream leaves no row twice.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        placed = placement.calibrated(placement.place_flat(batch, prototypes, k, kappa), scores)
        writers.write_tsv(writers.placement_rows(placed), f"{path}/epoch={epoch}")

    return each


def chimera_sink(path: str, kappa: float = KAPPA):
    """A foreachBatch function that scores the sequences of a batch of windows (whole sequences per batch)."""

    def each(batch: DataFrame, epoch: int) -> None:
        chimera_scores(batch, kappa).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return each


def online_thresholds(scores: DataFrame, most: int = C.MOST_SCORES, least: int = C.HPLG_LEAST) -> DataFrame:
    """Thresholds per rank after each batch of a stream of ``(rank, score)``; the state keeps the ``most`` latest scores."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for b in batches:
            held += b["score"].dropna().tolist()
        held = held[-most:]
        state.update((held,))
        own = sorted(held)
        pick = lambda e: own[min(math.ceil((len(own) + 1) * (1 - e)) - 1, len(own) - 1)] if len(own) >= least else None
        yield pd.DataFrame({"rank": [key[0]], "n": [len(own)], "q_accept": [pick(0.10)], "q_fallback": [pick(0.01)]})

    return scores.select("rank", "score").groupBy("rank").applyInPandasWithState(
        update, "rank int, n long, q_accept double, q_fallback double", "scores array<double>", "update", GroupStateTimeout.NoTimeout
    )


def online_students(observations: DataFrame, bank: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """Students after each batch of ``(taxon_id, ordinal, embedding)``; the state starts from ``bank``, one broadcast row per taxon."""
    start = {r["taxon_id"]: (r["rank"], r["student"], r["teacher"], r["teacher_count"], r["observation_count"]) for r in bank.toLocalIterator()}

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] not in start:
            return
        rank, student, teacher, seen, n = start[key[0]]
        if state.exists:
            student, n = state.get
        student, teacher = np.asarray(student, float), np.asarray(teacher, float)
        for x in pd.concat(list(batches)).sort_values("ordinal")["embedding"]:
            student, taken = hplg.ema_step(student, teacher, seen, np.asarray(x, float), hplg.momentum_of(rank), kappa)
            n += taken
        state.update((student.tolist(), int(n)))
        yield pd.DataFrame({"taxon_id": [key[0]], "student": [student.tolist()], "observation_count": [n]})

    return observations.select("taxon_id", "ordinal", "embedding").groupBy("taxon_id").applyInPandasWithState(
        update, "taxon_id string, student array<double>, observation_count long", "student array<double>, n long", "update", GroupStateTimeout.NoTimeout
    )


def curvature_monitor(history: DataFrame, window: int = 50, limit: float = 0.005) -> DataFrame:
    """State of each run after each batch of ``(run, step, kappa)``: the last values, the phase and its length are kept."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, phase, steps, n = state.get if state.exists else ([], "functional", 0, 0)
        last = list(last)
        rows = []
        for r in pd.concat(list(batches)).sort_values("step").itertuples():
            p = min(1.0, max(0.0, (r.kappa - KAPPA_FUNCTIONAL) / (KAPPA_PHYLOGENETIC - KAPPA_FUNCTIONAL)))
            now = "functional" if p < 0.05 else "phylogenetic" if p > 0.95 else "transition"
            steps, phase = (steps + 1, phase) if now == phase else (0, now)
            last, n = [*last, r.kappa][-window:], n + 1
            rows.append((key[0], r.step, r.kappa, now, bool(np.std(last) < limit) if n >= window else n < 10, steps))
        state.update((last, phase, steps, n))
        yield pd.DataFrame(rows, columns=["run", "step", "kappa", "phase", "is_stable", "steps_in_phase"])

    kinds = dict(history.dtypes)
    return history.select("run", "step", "kappa").groupBy("run").applyInPandasWithState(
        update, f"run {kinds['run']}, step {kinds['step']}, kappa double, phase string, is_stable boolean, steps_in_phase int", "last array<double>, phase string, steps int, n long", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Event-time extension: per window and type, the number and mean of scores, with late rows dropped after ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
