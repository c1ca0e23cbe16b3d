"""Sessions as keyed state in Structured Streaming: only ids and filters are kept, no answers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "session string, turn long, generation long, active_rally string, active_driver string, stale boolean"
STATE = "generation long, active_rally string, active_driver string"
IDLE_MS = 30 * 60 * 1000


def fold(rows: list[dict[str, Any]], state: tuple[Any, Any, Any]) -> tuple[list[tuple], tuple[Any, Any, Any]]:
    """Turns in order after a state: (output rows, new state).

    A turn of an older generation than the newest is stale: it comes out so marked and changes
    nothing. Others set the referents they name and keep the rest.
    """
    generation, rally, driver = state
    out = []
    for r in rows:
        late = generation is not None and r["generation"] < generation
        if not late:
            generation = r["generation"]
            rally, driver = r["rally"] or rally, r["driver"] or driver
        out.append((r["session"], r["turn"], r["generation"], rally, driver, late))
    return out, (generation, rally, driver)


def session_states(turns: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The folded turns of a stream (session, turn, generation, rally, driver).

    Sessions without a turn for `idle_ms` expire, which keeps the state bounded; None keeps
    them, for streams that end.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("turn").astype(object).where(lambda x: x.notna(), None).to_dict("records")
        out, new = fold(rows, state.get if state.exists else (None, None, None))
        state.update(new)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return turns.groupBy("session").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def session_folds(turns: DataFrame) -> DataFrame:
    """The same over a finished table of turns."""

    def whole(turns_of_one: pd.DataFrame) -> pd.DataFrame:
        rows = turns_of_one.sort_values("turn").astype(object).where(lambda x: x.notna(), None).to_dict("records")
        return pd.DataFrame(fold(rows, (None, None, None))[0], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return turns.groupBy("session").applyInPandas(whole, OUTPUT)
