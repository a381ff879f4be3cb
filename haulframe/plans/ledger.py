"""Record of the tables a run of ``load_all`` has finished, so that a failed run can resume."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import SparkSession

from haulframe.contract import Contract
from haulframe.sources.storage import Storage


class RunLedger:
    """One small file for each finished table, in the run's own folder of a shared path.

    A file is written beside its place and renamed into it once the table's rows are in, so a
    record never speaks of a load that did not end. It holds for the contract it was written
    under: a table whose contract has changed since counts as unfinished, and so does one whose
    target is gone. A load that stops between its commit and its record runs again, which a full
    load and a load above a mark bear; appends without a mark would repeat their rows.
    """

    def __init__(self, spark: SparkSession, path: str, run: str):
        """``run`` names the run to begin or to resume; another name loads everything again."""
        if not run:
            raise ValueError("a run needs a name")
        self.spark = spark
        self.folder = f"{path.rstrip('/')}/run={quote(run, safe='')}"
        self._storage = Storage(spark, self.folder)

    def finished(self, contract: Contract) -> dict | None:
        """What the run noted of a table; None while it has to be loaded."""
        return self._records().get((*contract.key, fingerprint(contract)))

    def all_finished(self) -> Callable[[Contract], dict | None]:
        """``finished`` over the records of this moment, read once."""
        records = self._records()
        return lambda contract: records.get((*contract.key, fingerprint(contract)))

    def note(self, contract: Contract, table: str, kind: str, rows: int, watermark: str | None,
             seconds: float) -> None:
        record = {"schema": contract.schema, "contract": fingerprint(contract),
                  "name": contract.table, "table": table, "kind": kind, "rows": rows,
                  "watermark": watermark, "seconds": seconds}
        place = hashlib.sha256(json.dumps(contract.key).encode()).hexdigest()
        self._storage.make_dir(self.folder)
        hidden, file = f"{self.folder}/.{place}", f"{self.folder}/{place}.json"
        self._storage.write_text(hidden, json.dumps(record))
        self._storage.delete(file)
        self._storage.rename(hidden, file)

    def _records(self) -> dict[tuple, dict]:
        if not self._storage.exists(self.folder):
            return {}
        lines = (self._storage.read_text(f"{self.folder}/{n}")
                 for n in self._storage.list(self.folder) if n.endswith(".json"))
        found = [json.loads(line) for line in lines]
        return {(r["schema"], r["name"], r["contract"]): r for r in found}


def fingerprint(contract: Contract) -> str:
    """Digest of all that a contract declares."""
    return hashlib.sha256(json.dumps(contract.to_dict(), sort_keys=True, default=str)
                          .encode()).hexdigest()
