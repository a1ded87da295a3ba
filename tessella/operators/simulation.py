"""Discrete event simulation and stochastic search as independent Spark tasks.

A single event line is sequential by nature; what scales is many of them. Each
group (a trajectory, a customer, a restart) is one sequence in one task, and groups
run side by side.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simulate(events: DataFrame, key: str, time: str, initial: dict, process: Callable, schema: str, max_events: int | None = None, end=None) -> DataFrame:
    """Run each key's scheduled events in order of time, then of arrival.

    ``process(state, time, event)`` gives the state and a list of (time, event) to
    schedule, an event being a dict of the other columns. An event before the
    present is an error. ``schema`` names the key, the state's fields,
    events_processed and final_time.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(rows.columns), kind="stable")
        state, done, now = dict(initial), 0, None
        heap = [(t, i, e) for i, (t, e) in enumerate(zip(rows[time], rows.drop(columns=[key, time]).to_dict("records"), strict=True))]
        heapq.heapify(heap)
        count = len(heap)
        while heap and (max_events is None or done < max_events):
            t, _, event = heapq.heappop(heap)
            if end is not None and t > end:
                break
            now = t
            state, more = process(state, t, event)
            done += 1
            for when, what in more:
                if when < now:
                    raise ValueError(f"event at {when} is before the present, {now}")
                heapq.heappush(heap, (when, count, what))
                count += 1
        return pd.DataFrame([{key: rows[key].iloc[0], **state, "events_processed": done, "final_time": now}])

    return events.groupBy(key).applyInPandas(run, schema)


def trajectories(spark, n: int, run: Callable, schema: str, seed: int = 0) -> DataFrame:
    """n independent seeded runs: ``run(rng)`` gives a dict; rows are trajectory and its fields."""
    import numpy as np

    def each(batches):
        for batch in batches:
            yield pd.DataFrame([{"trajectory": int(k), **run(np.random.default_rng(seed + int(k)))} for k in batch["id"]])

    return spark.range(n).repartition(min(max(1, n), spark.sparkContext.defaultParallelism * 4)).mapInPandas(each, schema)


def anneal(spark, start, energy: Callable, move: Callable, restarts: int = 8, steps: int = 2000, hot: float = 10.0, cold: float = 0.01, seed: int = 0) -> dict:
    """Simulated annealing from many restarts side by side; the best state and its energy."""
    import json
    import math

    def run(rng):
        state = start
        now = best = energy(state)
        kept = state
        for k in range(steps):
            t = hot * (cold / hot) ** (k / max(1, steps - 1))
            new = move(state, rng)
            e = energy(new)
            if e <= now or rng.random() < math.exp((now - e) / t):
                state, now = new, e
                if e < best:
                    best, kept = e, new
        return {"energy": float(best), "state": json.dumps(kept)}

    rows = trajectories(spark, restarts, run, "trajectory long, energy double, state string", seed)
    first = rows.orderBy("energy", "trajectory").limit(1).first()
    return {"energy": first["energy"], "state": json.loads(first["state"])}


def anneal_permutation(spark, n: int, energy: Callable, **how) -> dict:
    """Annealing over orders of 0..n-1 by swaps."""

    def move(p, rng):
        i, j = rng.integers(0, n, 2)
        q = list(p)
        q[i], q[j] = q[j], q[i]
        return q

    return anneal(spark, list(range(n)), energy, move, **how)


def anneal_subset(spark, n: int, energy: Callable, **how) -> dict:
    """Annealing over subsets of 0..n-1 by flips."""

    def move(s, rng):
        q = list(s)
        q[int(rng.integers(0, n))] ^= True
        return q

    return anneal(spark, [False] * n, energy, move, **how)


def coordinate_search(spark, choices: list[list], objective: Callable, restarts: int = 8, rounds: int = 20, seed: int = 0) -> dict:
    """Largest objective over discrete choices: one position at a time is set to its best, from many starts side by side."""
    import json

    def run(rng):
        state = [c[int(rng.integers(0, len(c)))] for c in choices]
        best = objective(state)
        for _ in range(rounds):
            before = best
            for k, options in enumerate(choices):
                for o in options:
                    trial = [*state[:k], o, *state[k + 1 :]]
                    value = objective(trial)
                    if value > best:
                        best, state = value, trial
            if best == before:
                break
        return {"value": float(best), "state": json.dumps(state)}

    rows = trajectories(spark, restarts, run, "trajectory long, value double, state string", seed)
    first = rows.orderBy(F.desc("value"), "trajectory").limit(1).first()
    return {"value": first["value"], "state": json.loads(first["state"])}


def search_space(spark, space: dict[str, tuple], objective: Callable, trials: int = 64, seed: int = 0) -> DataFrame:
    """Random search: trial, parameters and value; a space entry is (low, high) or a list of choices."""
    names = list(space)

    def run(rng):
        params = {k: (v[int(rng.integers(0, len(v)))] if isinstance(v, list) else float(rng.uniform(*v))) for k, v in space.items()}
        return {**params, "value": float(objective(params))}

    kinds = {k: ("double" if isinstance(v, tuple) or isinstance(v[0], float) else "long" if isinstance(v[0], int) else "string") for k, v in space.items()}
    return trajectories(spark, trials, run, "trajectory long, " + ", ".join(f"{k} {kinds[k]}" for k in names) + ", value double", seed)
