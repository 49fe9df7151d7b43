"""Model replies as data: prompts as columns, recorded replies, and an optional live client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tries and pauses (seconds) of the four kinds of call.
TRIES = {"vet": 2, "blocks": 3, "lines": 2, "query": 1}
PAUSE = {"vet": 2.0, "blocks": 2.0, "lines": 2.0, "query": 0.0}


def prompt(template: str, **parts: Column) -> Column:
    """A template with {names} filled from columns."""
    out, rest = [], template
    while rest:
        at = min((k for k in (rest.find("{" + n + "}") for n in parts) if k >= 0), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        out += [F.lit(rest[:at]), parts[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out)


def recorded(prompts: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts with their recorded replies; '' where there is none."""
    return prompts.join(replies, keys, "left").withColumn("raw", F.coalesce("raw", F.lit("")))


def live(prompts: DataFrame, call: Callable[[str], str], kind: str = "vet") -> DataFrame:
    """Prompts with replies of call, tried again within the partition; '' after the last failure.

    A task that is run again calls again, so call must bear repetition.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in prompts.schema)}, raw string"
    tries, pause = TRIES[kind], PAUSE[kind]

    def ask(text: str) -> str:
        for k in range(tries):
            try:
                if reply := call(text):
                    return reply
            except Exception:  # of any client
                pass
            if k + 1 < tries:
                time.sleep(pause)
        return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(raw=[ask(p) for p in pdf["prompt"]])

    return prompts.mapInPandas(run, schema)
