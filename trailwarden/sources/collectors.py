"""Several collectors in one poll."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Collector:
    """A named source of events; ``commit`` runs only after delivery."""

    name: str
    collect: Callable[[], DataFrame]
    commit: Callable[[], None] | None = None


def collect_all(collectors: list[Collector]) -> DataFrame:
    """All collectors' events under a ``source`` column."""
    parts = [c.collect().withColumn("source", F.lit(c.name)) for c in collectors]
    return reduce(lambda a, b: a.unionByName(b), parts)


def poll(collectors: list[Collector], deliver: Callable[[DataFrame], None]) -> dict[str, bool]:
    """Deliver each collector's batch as its own job.

    A failing collector or delivery is logged and left uncommitted, so its rows
    are read again next time; the others go on.
    """
    outcome = {}
    for c in collectors:
        try:
            deliver(c.collect())
            if c.commit:
                c.commit()
            outcome[c.name] = True
        except Exception as e:
            log.warning("%s: collection failed, will retry next poll: %s", c.name, e)
            outcome[c.name] = False
    return outcome
