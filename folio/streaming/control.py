"""Batch control while work runs: answers that stick, percent done, and cancels, as one stateful stream.

A row is something that happened to a batch at a time (``at``): a folder asks what to do with its outputs, a file of a folder is started or
done, or someone cancels a folder (or, with a null folder, the batch). Rows of a batch are kept in its state until the watermark has passed them, and are then taken in order
of (at, seq), so what comes out doesn't depend on when a row arrives within ``late``; rows that are later still are dropped by the watermark, as everywhere in Spark. A timer takes what is due when
no more rows come. State of a batch: its answer to all, when it was cancelled, how many files of each open folder are done, and the rows that wait; a folder that
is done is forgotten, and so is a batch without news for ``forget``.

What comes out is what :func:`folio.sources.batch.answered`, ``progress`` and ``until_cancelled`` say of the same rows at rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: kind: ask (n: outputs that are there, answer), open (n: files of the folder), start, done, cancel.
ROWS = "batch string, seq long, at timestamp, kind string, folder string, n long, answer string"
#: outcome: of ask as ``answered`` says, of start runs or cancelled, of done null; percent: of done.
OUT = "batch string, seq long, kind string, folder string, outcome string, percent long"
STATE = "memory string"
STICKY = ("YesToAll", "NoToAll", "Cancel")


def fresh() -> dict:
    return {"answer": None, "all_off": None, "off": {}, "total": {}, "done": {}, "waiting": []}


def take(memory: dict, at: int, seq: int, kind: str, folder: str | None, n: int | None, answer: str | None) -> tuple | None:
    """Takes one row in order, and gives (seq, kind, folder, outcome, percent) or nothing."""
    if kind == "ask":
        asks = bool(n)
        said = memory["answer"] or (answer if asks else None)
        if asks and not memory["answer"] and answer in STICKY:
            memory["answer"] = answer
        outcome = "cancelled" if said == "Cancel" else "fresh" if not asks else "overwrite" if said in ("Yes", "YesToAll") else "keep"
        return seq, kind, folder, outcome, None
    if kind == "open":
        memory["total"][folder] = n
    elif kind == "cancel":
        if folder is None:
            memory["all_off"] = at if memory["all_off"] is None else min(at, memory["all_off"])
        else:
            memory["off"][folder] = min(at, memory["off"].get(folder, at))
    elif kind == "start":
        off = any(x is not None and at >= x for x in (memory["all_off"], memory["off"].get(folder)))
        return seq, kind, folder, "cancelled" if off else "runs", None
    elif kind == "done":
        done, total = memory["done"].get(folder, 0) + 1, memory["total"].get(folder)
        memory["done"][folder] = done
        percent = round(100.0 * done / total) if total else None  # half to even
        if total and done >= total:
            memory["done"].pop(folder)
            memory["total"].pop(folder)
        return seq, kind, folder, None, percent
    return None


def controlled(rows: DataFrame, late: str = "10 minutes", forget: str = "7 days") -> DataFrame:
    """What happens to each ask, start and done of the stream ``rows``."""
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = json.loads(state.get[0]) if state.exists else fresh()
        for batch in batches:
            for when, seq, kind, folder, n, answer in zip(batch["micros"], batch["seq"], batch["kind"], batch["folder"], batch["n"], batch["answer"]):
                memory["waiting"].append([int(when), int(seq), kind, *(None if pd.isna(x) else x for x in (folder, None if pd.isna(n) else int(n), answer))])
        mark = state.getCurrentWatermarkMs() * 1000
        # At one instant a cancel comes before all else, as work that starts with it is off, and a folder is open before its files are done.
        memory["waiting"].sort(key=lambda w: (w[0], ("cancel", "open").index(w[2]) if w[2] in ("cancel", "open") else 2, w[1]))
        due = [w for w in memory["waiting"] if w[0] <= mark]
        memory["waiting"] = memory["waiting"][len(due) :]
        out = [(key[0], *x) for w in due if (x := take(memory, *w)) is not None]
        if state.hasTimedOut and not memory["waiting"] and not due:
            state.remove()
        else:
            state.update((json.dumps(memory),))
            soon = memory["waiting"][0][0] // 1000 + 1 if memory["waiting"] else mark // 1000 + wait
            state.setTimeoutTimestamp(max(soon, mark // 1000 + 1))
        frame = pd.DataFrame(out, columns=["batch", "seq", "kind", "folder", "outcome", "percent"])
        frame["percent"] = frame["percent"].astype("Int64")
        yield frame

    named = rows.select("batch", "seq", "at", F.unix_micros("at").alias("micros"), "kind", "folder", "n", "answer").withWatermark("at", late)
    return named.groupBy("batch").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout).select("batch", "seq", "kind", "folder", "outcome", F.col("percent"))
