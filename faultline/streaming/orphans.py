"""The orphan ledger over a stream: every micro-batch of references and arrivals moves the keyed state on."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.orphans import KEYS, REF, OrphanLedger
from faultline.session import cut, read_text, write_text


class LedgerStream:
    """Feed ``write`` to ``foreachBatch`` of a stream of (event, ref_table, ref_id, ref_key, at).

    ``event`` is ``ref``, ``parent`` or, with ``follow_deletions``, ``delete``. The segments of the ledger lie in ``root``, and the file
    ``pointer`` there names those that hold and the last batch; it is replaced in one step after they are
    written. A new object goes on from it, and a batch delivered again is left out.
    """

    def __init__(self, spark: SparkSession, root: str, follow_deletions: bool = False, at_type: str = "timestamp"):
        self.spark, self.root, self.follow_deletions, self.at_type = spark, root.rstrip("/"), follow_deletions, at_type

    def _pointer(self) -> dict | None:
        text = read_text(self.spark, f"{self.root}/pointer")
        return json.loads(text) if text else None

    def ledger(self) -> OrphanLedger:
        held, at = OrphanLedger.empty(self.spark, self.follow_deletions, self.root, self.at_type), self._pointer()
        if at:
            held.seq, held.index, held.refs = at["seq"], [tuple(x) for x in at["index"]], [tuple(x) for x in at["refs"]]
        return held

    def write(self, batch: DataFrame, number: int) -> None:
        at = self._pointer()
        if at and number <= at["batch"]:
            return
        batch = cut(batch)
        gone = batch.where("event = 'delete'").select(*KEYS) if self.follow_deletions else None
        after = self.ledger().apply(batch.where("event = 'ref'").select(*REF), batch.where("event = 'parent'").select(*KEYS, "at"), gone)
        write_text(self.spark, f"{self.root}/pointer", json.dumps({"batch": number, "seq": after.seq, "index": after.index, "refs": after.refs}))


def tumbling_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per window and key of a stream with a watermark; events later than ``late`` are left to the next run's batch."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
