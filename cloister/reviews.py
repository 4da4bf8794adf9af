"""Requests for review that wait in a store until the owner answers, from whatever session and at whatever time.

A request is a folder with ``request.json`` and, once answered, ``answer.json``; both are committed once, so of two answers the
first holds, and what is pending, allowed or denied is the same for everyone who shares the store.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from .sources.commits import children, commit_bytes, read_bytes

PENDING, ALLOWED, DENIED = "pending", "allowed", "denied"


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


@dataclass
class ReviewRequest:
    """What the owner sees of a result that waits for review."""

    query: str
    reason: str
    user: str | None
    schema: str


@dataclass
class ReviewQueue:
    spark: SparkSession
    folder: str

    def _file(self, name: str, kind: str) -> str:
        return f"{self.folder}/{name}/{kind}.json"

    def ask(self, name: str, request: ReviewRequest) -> bool:
        """File a request under a result's name; False if there is one."""
        return commit_bytes(self.spark, self._file(name, "request"), json.dumps(asdict(request) | {"asked": _now()}).encode())

    def answer(self, name: str, allow: bool, by: str | None = None, note: str = "") -> None:
        """Allow or deny a request; KeyError for an unknown one, ValueError for one that has an answer."""
        if self.state(name) is None:
            raise KeyError(name)
        if not commit_bytes(self.spark, self._file(name, "answer"), json.dumps({"allow": bool(allow), "by": by, "note": note, "at": _now()}).encode()):
            raise ValueError(f"{name} has been answered")

    def read(self, name: str) -> dict | None:
        """A request with its state and answer; None if there is none."""
        request = read_bytes(self.spark, self._file(name, "request"))
        if request is None:
            return None
        found = json.loads(request) | {"name": name, "state": PENDING, "by": None, "note": None}
        if (answer := read_bytes(self.spark, self._file(name, "answer"))) is not None:
            answer = json.loads(answer)
            found |= {"state": ALLOWED if answer["allow"] else DENIED, "by": answer["by"], "note": answer["note"]}
        return found

    def state(self, name: str) -> str | None:
        found = self.read(name)
        return found and found["state"]

    def requests(self, state: str | None = PENDING) -> list[dict]:
        """The requests in a state (None: all), oldest first."""
        found = [r for n in children(self.spark, self.folder) if (r := self.read(n)) is not None]
        return sorted((r for r in found if state in (None, r["state"])), key=lambda r: r["asked"])

    def table(self) -> DataFrame:
        columns = ("name", "state", "query", "reason", "user", "schema", "asked", "by", "note")
        return self.spark.createDataFrame([tuple(r[c] for c in columns) for r in self.requests(None)], ", ".join(f"`{c}` string" for c in columns))
