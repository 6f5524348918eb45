"""Streams: stateful preceding context per file, scoring by micro-batch with a checkpoint, windowed rates with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIZE = 8


def stream_context(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """``source_file, seq, context`` of each labelled row (``source_file, seq, speaker, sentence, label``), rendered as by ``preceding_context``: a ``[Name]``
    line where the speaker changes, ``>>> `` before the row itself.

    The state of a file is its last ``size`` rows; rows of a file must arrive in order across batches and are ordered by ``seq`` within one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get)] if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, who, text, label in zip(pdf["seq"], pdf["speaker"], pdf["sentence"], pdf["label"]):
            row = ((who or "").strip() or "unknown", (text or "").strip())
            if label:
                lines: list[str] = []
                last = None
                for k, (name, said) in enumerate([*held, row]):
                    lines += [f"[{name}]"] if name != last else []
                    lines.append((">>> " if k == len(held) else "") + said)
                    last = name
                out.append((key[0], int(seq), "\n".join(lines)))
            held = [*held, row][-size:]
        state.update(([w for w, _ in held], [t for _, t in held]))
        yield pd.DataFrame(out, columns=["source_file", "seq", "context"])

    return rows.groupBy("source_file").applyInPandasWithState(step, "source_file string, seq bigint, context string", "who array<string>, said array<string>", "append", GroupStateTimeout.NoTimeout)


def rates_by_window(events: DataFrame, at: str = "ts", kind: str = "event_type", delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per kind and window; events later than the delay don't reopen a window."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def process_once(rows: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str) -> None:
    """A work queue: what has arrived since the last call is transformed and appended; a batch repeated after a failure adds nothing twice."""

    def batch(df: DataFrame, _epoch: int) -> None:
        new = transform(df).dropDuplicates([key])
        spark = new.sparkSession
        try:
            done = spark.read.parquet(out).select(key)
        except Exception as e:  # no output yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(done, key, "left_anti")
        new.write.mode("append").parquet(out)

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
