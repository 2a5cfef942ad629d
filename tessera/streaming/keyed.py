"""Operators with a state per key: chunks put together by number, and runs of lines in the order of their time.

Both take their rows in any order within the watermark's delay, and drop a key's
state by event time: a key that is silent costs nothing after a while.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sanitize import line_key


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


#: Groups that the keys of reassembled() are dealt to. A stream that goes on from a checkpoint has to keep it.
BUCKETS = 1_024


def reassembled(chunks: DataFrame, by: str, ts: str = "ts", timeout_ms: int = 600_000, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """by, text, chunks, prompt_tokens, completion_tokens, closed: answers that came in numbered chunks.

    chunks: by, ts, seq (from 0), content, done, prompt_tokens,
    completion_tokens, error. They may come out of order, and twice: the first
    of a number counts. An answer is closed by `done` when its done chunk and
    all before it are there, with that chunk's usage; by `error` at once, its
    text the first error told and its usage zero; or by `timeout`, when the
    watermark has passed its last chunk by timeout_ms, with the text of the
    chunks that are there, in order. What comes after an answer is closed, and
    before its timeout, is a repeat and goes. Null contents are empty; chunks
    without number are not read.

    Keys are dealt to groups by their hash, and one call does all of a group in
    a batch: a call costs milliseconds, a chunk in it microseconds. The state of
    a group are its answers: chunks, or of a closed one its last time alone.
    by: a column that can be cast to text and back.
    """
    kind = dict(chunks.dtypes)[by]
    columns = ["key", "text", "chunks", "prompt_tokens", "completion_tokens", "closed"]
    read = ["key", "ms", "seq", "content", "done", "prompt_tokens", "completion_tokens"]

    def step(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # key: [last time, number and usage of the done chunk, contents by number]; of a closed answer the time alone
        held = {key: answer for key, *answer in json.loads(state.get[0])} if state.exists else {}
        out, rows, failed, touched = [], [], {}, set()

        def close(key: str | None, how: str) -> None:
            _, _, usage, parts = held[key]
            out.append((key, "".join(parts[k] for k in sorted(parts, key=int)), len(parts), *usage, how))

        for frame in [] if state.hasTimedOut else frames:
            rows += zip(*[frame[c].tolist() for c in read], strict=True)
            for key, error in frame.loc[frame["error"].notna(), ["key", "error"]].itertuples(index=False, name=None):
                failed[key] = min(error, failed.get(key, error))
        for key, ms, *_ in rows:
            answer = held.setdefault(key, [0, None, [0, 0], {}])
            answer[0] = max(answer[0], ms)
        for key, error in failed.items():
            if len(held[key]) > 1:
                out.append((key, error, 0, 0, 0, "error"))
                del held[key][1:]
        for key, _, seq, text, done, *usage in rows:
            answer = held[key]
            if len(answer) > 1 and seq and seq not in answer[3]:
                answer[3][seq] = text
                touched.add(key)
                if done:
                    answer[1:3] = int(seq), usage
        for key in touched:
            _, last, _, parts = held[key]
            if last is not None and len(parts) > last and all(str(k) in parts for k in range(last + 1)):
                held[key][3] = {k: v for k, v in parts.items() if int(k) <= last}
                close(key, "done")
                del held[key][1:]
        # rows of a batch may come just before the time-out of their key that the same batch has reached
        watermark = state.getCurrentWatermarkMs()
        for key in [key for key, answer in held.items() if answer[0] + timeout_ms < watermark]:
            if len(held[key]) > 1:
                close(key, "timeout")
            del held[key]
        if held:
            state.update((json.dumps([(key, *answer) for key, answer in held.items()], ensure_ascii=False, separators=(",", ":")),))
            state.setTimeoutTimestamp(max(min(answer[0] for answer in held.values()) + timeout_ms, watermark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    tokens = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in columns[3:5]]
    # numbers as text: the names of the contents in the state
    texts = [F.col(by).cast("string").alias("key"), F.col("seq").cast("long").cast("string").alias("seq"), F.coalesce("content", F.lit("")).alias("content"), "error"]
    own = chunks.select(F.pmod(F.xxhash64(by), F.lit(buckets)).alias("bucket"), F.col(ts).alias("ts"), F.coalesce(F.unix_millis(ts), F.lit(0)).alias("ms"), F.coalesce("done", F.lit(False)).alias("done"), *tokens, *texts)
    schema = "key string, text string, chunks int, prompt_tokens long, completion_tokens long, closed string"
    closed = own.withWatermark("ts", late).groupBy("bucket").applyInPandasWithState(step, schema, "held string", "append", "EventTimeTimeout")
    return closed.select(F.col("key").cast(kind).alias(by), *columns[1:])


def runs_in_order(lines: DataFrame, by: str, ts: str = "ts", order: str | None = None, line: str = "line", late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """by, first, n: runs of equal lines (time stamps aside) per key, in the order of ts and then of `order`, whatever order they come in.

    Rows are held back until the watermark has passed them, so that none can
    come before them any more; then they go into the runs in order. A run is
    closed by a different line, or by a silence of more than idle_ms after its
    last line: then it is given and the key's state goes. The state of a key are
    the rows within the delay and its open run.
    """
    kind = dict(lines.dtypes)[by]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"rows": [], "run": None}
        rows, run, out = held["rows"], held["run"], []
        if not state.hasTimedOut:
            for frame in frames:
                rows += [list(r) for r in zip(_micros(frame["ts"]).tolist(), frame["order"].tolist(), frame["key"], frame["line"], strict=True)]
        passed = max(state.getCurrentWatermarkMs(), 0) * 1000
        rows.sort(key=lambda r: (r[0], r[1]))
        n = next((i for i, r in enumerate(rows) if r[0] > passed), len(rows))
        for at, _, same, text in rows[:n]:
            if run and (run["key"] != same or at - run["at"] > idle_ms * 1000):
                out.append((key[0], run["first"], run["n"]))
                run = None
            run = {"key": same, "first": run["first"] if run else text, "n": run["n"] + 1 if run else 1, "at": at}
        rows = rows[n:]
        if run and passed - run["at"] > idle_ms * 1000:
            out.append((key[0], run["first"], run["n"]))
            run = None
        if run or rows:
            state.update((json.dumps({"rows": rows, "run": run}),))
            due = min([r[0] // 1000 for r in rows[:1]] + ([run["at"] // 1000 + idle_ms] if run else []))
            state.setTimeoutTimestamp(max(due, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[by, "first", "n"])

    second = F.col(order) if order else F.lit(0)
    own = lines.select(by, F.col(ts).alias("ts"), second.cast("long").alias("order"), line_key(F.col(line)).alias("key"), F.col(line).alias("line"))
    return own.withWatermark("ts", late).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, first string, n long", "held string", "append", "EventTimeTimeout")
