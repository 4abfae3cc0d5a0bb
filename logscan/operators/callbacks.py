"""User code on matches, never on lines: Arrow batches of pandas frames."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from logscan.model import KEY, LEVELS, ORD


def on_match(matches: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], mode: str = "plain", columns: tuple = ("tag", "level", "message")) -> DataFrame:
    """columns and origin of the events after call has seen the matches.

    call gets a frame of matches and returns one with level and message, a row each; OK is an
    event too. plain keeps the matches only, smart has matches and results, supersmart results
    only. If a call fails, the batch's matches stay and one WARNING a tag says so.
    """
    cols = [f for f in matches.schema.fields if f.name in columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols) + ", origin string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame[list(columns)].assign(origin="match")
            try:
                result = call(frame)
                got = own.assign(origin="callback", level=result["level"].map(lambda x: x if x in LEVELS else "UNKNOWN").values, message=result["message"].values)
            except Exception as e:  # the user's code, whatever it does
                yield own
                yield own.drop_duplicates("tag").assign(origin="failure", level="WARNING", message=f"could not execute callback: {e}")
                continue
            if mode != "supersmart":
                yield own
            if mode != "plain":
                yield got

    out = matches.mapInPandas(run, schema)
    failures = out.filter("origin = 'failure'").dropDuplicates(["tag"])
    return out.filter("origin <> 'failure'").unionByName(failures)


def _by_key(frames: Iterator[pd.DataFrame], key: tuple) -> Iterator[tuple[tuple, pd.DataFrame, bool]]:
    """Parts of sorted frames with one key each, and whether a part is the first of its key; a key may go on in the next frame."""
    last = None
    for frame in frames:
        if len(frame):
            change = (frame[list(key)].fillna("") != frame[list(key)].fillna("").shift()).any(axis=1).cumsum()
            for _, part in frame.groupby(change.values, sort=False):
                now = tuple(part.iloc[0][list(key)])
                yield now, part, now != last
                last = now


def with_state(matches: DataFrame, call: Callable[[pd.DataFrame, dict], pd.DataFrame], mode: str = "plain", private: DataFrame | None = None, key: tuple = KEY, order: tuple = (*ORD, "pat_pos"), also: tuple = ()) -> DataFrame:
    """tag, host, logfile, level, message, the order, origin and private (on rows of origin `state`): the events after call has seen the matches of each key in order.

    call gets a frame of matches and a dict of texts, and returns a frame with level and message,
    a row each, as in on_match; what it puts into the dict is there for the key's next matches and, if
    the rows of origin `state` are given as private (key, private) then, in the next run. A key with
    many matches comes in several frames, so no key is held whole. also: further columns of matches that call sees.
    """
    cols = [*key, "level", "message", *order]
    rows = matches.select(*cols, *also)
    if private is not None:
        rows = rows.join(private.select(*key, "private"), list(key), "left")
    else:
        rows = rows.withColumn("private", F.lit(None).cast("map<string,string>"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in cols) + ", origin string, private map<string,string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        before = None

        def state(k: tuple) -> pd.DataFrame:
            return pd.DataFrame([dict.fromkeys(cols) | dict(zip(key, k, strict=True)) | {"origin": "state", "private": held}], dtype=object)

        for k, part, first in _by_key(frames, key):
            if first:
                if before is not None:
                    yield state(before)
                given = part.iloc[0]["private"]
                held, before = dict(given) if given is not None else {}, k
            own = part[cols].astype(object).assign(origin="match", private=None).astype(object)
            try:
                result = call(part[[*cols, *also]], held)
                got = own.assign(origin="callback", level=[x if x in LEVELS else "UNKNOWN" for x in result["level"]], message=list(result["message"])).astype(object)
            except Exception as e:  # the user's code, whatever it does
                yield own
                yield own.head(1).assign(origin="failure", level="WARNING", message=f"could not execute callback: {e}").astype(object)
                continue
            if mode != "supersmart":
                yield own
            if mode != "plain":
                yield got
        if before is not None:
            yield state(before)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def flood(matches: DataFrame, max_events: int, period: int, key: tuple = ("tag",), when: str = "when", push_after_shift: bool = True) -> DataFrame:
    """matches with wait: seconds to the next event allowed, 0 if the event is allowed.

    A history of max_events times: once it is full an event must come period seconds after the
    oldest; if it does, the oldest goes, and the event is added (push_after_shift) or not. Each
    event depends on all before it, so a key is one sequence; its rows stream through a task in the
    order of time, with no more than the history held. Equal times are in the order of the other columns. An
    event without a time is allowed and leaves the history as it is.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema.fields) + ", wait long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        history: deque = deque()
        for _, part, first in _by_key(frames, key):
            if first:
                history.clear()
            waits = []
            for t in part["_at"] / 1e6:
                wait = 0
                if t != t:  # no time
                    pass
                elif len(history) >= max_events:
                    wait = max(0, int(history[0] + len(history) * period / max_events - t))
                    if not wait:
                        history.popleft()
                        if push_after_shift:
                            history.append(t)
                else:
                    history.append(t)
                waits.append(wait)
            yield part.drop(columns="_at").assign(wait=waits)

    timed = matches.withColumn("_at", F.unix_micros(F.col(when).cast("timestamp")))
    rest = [f.name for f in matches.schema.fields if f.name not in key and not isinstance(f.dataType, (MapType, VariantType))]
    return timed.repartition(*key).sortWithinPartitions(*key, "_at", *rest).mapInPandas(run, schema)


def count_waits(rows: DataFrame, key: tuple = ("tag",)) -> DataFrame:
    return rows.groupBy(*key).agg(F.count_if(F.col("wait") > 0).alias("flooded"), F.count_if(F.col("wait") == 0).alias("allowed"))
