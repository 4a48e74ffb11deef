"""The guard over a stream of questions, and bounded conversation state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.guard import check_input


def guard_stream(questions: DataFrame, question: str = "question") -> DataFrame:
    """Adds the input check to each question of a stream; it keeps no state."""
    return questions.withColumn("check", check_input(F.col(question)))


def refusals_by_window(questions: DataFrame, at: str, question: str = "question", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Questions and refused ones per window of event time; later ones than ``late`` are left out."""
    checked = guard_stream(questions, question).withWatermark(at, late)
    return checked.groupBy(F.window(at, width).alias("span")).agg(F.count(F.lit(1)).alias("questions"), F.count_if(~F.col("check.safe")).alias("refused"))


def bounded_history(turns: DataFrame, most: int = 5, width: int = 200) -> DataFrame:
    """W1 on a stream of (conv_id, turn, role, text): each turn with the last 2 x most messages of its conversation."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        for batch in batches:
            out = []
            for r in batch.sort_values("turn").itertuples():
                past = [*past, f"{r.role}: {(r.text or '')[:width]}"][-2 * most :]
                out.append((key[0], r.turn, "\n".join(past)))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "history"])
        state.update((past,))

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id bigint, turn bigint, history string", "past array<string>", "append", GroupStateTimeout.NoTimeout)
