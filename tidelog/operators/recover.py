"""Recovery: what a store is after a restart, from its edit log, its files and its write-ahead logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import layout, state


@dataclass
class Recovered:
    log: DataFrame  # the newest version of each key, deletes included, with new sequences
    files: DataFrame  # the live files of the last edit
    orphans: DataFrame  # files with entries that no edit names; reported, never deleted
    highest: int  # the last sequence before recovery


def recover(edits: DataFrame, entries: DataFrame, wal: DataFrame) -> Recovered:
    """Replays the edit log, refusing a corrupt one, reads the entries of live files only, adds the write-ahead logs' mutations,
    and keeps one version of each key under sequences after all that were ever issued, in key order.
    """
    files = layout.replay_strict(edits)
    mutation = ["key", "seq", "tombstone", "value"]
    flushed = entries.join(files.select("file_number"), "file_number", "left_semi").select(*mutation)
    every = flushed.unionByName(wal.select(*mutation))
    counted = layout.counters(edits).where("kind = 'SET_LAST_SEQUENCE'").agg(F.max("value")).first()[0] or 0
    highest = max(counted, every.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0])
    orphans = layout.orphans(entries.select("file_number").distinct(), files)
    return Recovered(state.reload(every, highest), files, orphans, highest)
