"""The session: Spark settings, the catalogue of guarded tables, users, and the release of results."""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lineage
from .policy import DEFAULT, Action, Policy, TrueRule, Verdict, judge
from .reviews import ALLOWED, PENDING, ReviewQueue, ReviewRequest


class RequestRejected(PermissionError):
    """The policy of a source does not allow the release."""


class ReviewPending(RequestRejected):
    """The owner has not answered yet."""


class NotFound(KeyError):
    """No table of that name is in the catalogue."""


class UnsupportedOperation(NotImplementedError):
    """An operator that guarded frames do not offer."""


@dataclass
class Artifact:
    """A table of the catalogue.  ``verdict`` says whether the table itself may be fetched."""

    df: DataFrame
    policy: Policy
    verdict: Verdict
    blacklist: frozenset[str] = frozenset()
    query: str = ""
    owner: str | None = None
    order: tuple[str, ...] = ()


@dataclass
class GuardSession:
    """Entry point.  ``reviewer`` answers review requests at once and denies by default; with a folder ``reviews`` they wait there instead for
    an owner's answer, from any session.  ``store`` is the folder of saved tables.

    An aggregate of all rows stands for as many rows as there are, and one that holds the values of single rows (lists, first and last ones) for
    one.  ``strict=False`` is the compatible mode, in which the former stands for any number of rows and the latter for its group."""

    spark: SparkSession
    user: str | None = None
    is_owner: bool = True
    reviewer: Callable[[ReviewRequest], bool] = lambda request: False
    store: str | None = None
    strict: bool = True
    reviews: str | None = None
    catalogue: dict[str, Artifact] = field(default_factory=dict)
    events: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark.conf.set("spark.sql.ansi.enabled", "true")
        if self.store:
            self._reload()

    def log(self, event: str, **details) -> None:
        self.events.append({"time": datetime.datetime.now(datetime.UTC).isoformat(), "event": event, "user": self.user, **details})

    # Catalogue.

    def send_df(self, df, policy: Policy = DEFAULT, sanitized_columns: tuple[str, ...] | list[str] = (), name: str | None = None, order_by: tuple[str, ...] = ()):
        """Register a Spark, pandas or Arrow table (owners only); the table itself may never be fetched, whatever its policy."""
        self._owned("register tables")
        if not isinstance(df, DataFrame):
            df = self.spark.createDataFrame(df)
        name = name or uuid.uuid4().hex
        self.catalogue[name] = Artifact(df, policy, Verdict(Action.REJECT, "source tables are not released"), frozenset(sanitized_columns), "", self.user, tuple(order_by))
        self.log("send_df", name=name)
        return self.get_df(name)

    def read(self, path: str, format: str = "parquet", policy: Policy = DEFAULT, sanitized_columns: tuple[str, ...] = (), schema=None, name: str | None = None, order_by: tuple[str, ...] = (), **options):
        """Register files of any format that Spark reads (owners only)."""
        self._owned("register tables")
        reader = self.spark.read.format(format).options(**options)
        return self.send_df((reader.schema(schema) if schema else reader).load(path), policy, sanitized_columns, name, order_by)

    def _owned(self, action: str) -> None:
        if not self.is_owner:
            raise RequestRejected(f"only the owner may {action}")

    def artifact(self, name: str) -> Artifact:
        if name not in self.catalogue:
            raise NotFound(name)
        return self.catalogue[name]

    def get_df(self, name: str):
        from .frame import GuardedFrame

        found = self.artifact(name)
        return GuardedFrame(self, found.df, lineage.source(name), found.blacklist, tuple(found.order), name, f"scan({name})")

    def list_dfs(self) -> DataFrame:
        rows = [(n, a.df.schema.json(), a.query, a.verdict.safe) for n, a in self.catalogue.items()]
        return self.spark.createDataFrame(rows, "name string, header string, query string, fetchable boolean")

    def header(self, name: str) -> str:
        return self.artifact(name).df.schema.json()

    def delete(self, name: str) -> None:
        """Owners only."""
        self._owned("delete")
        self.artifact(name)
        del self.catalogue[name]
        if self.store:
            from .sources.scratch import remove_path

            remove_path(self.spark, f"{self.store}/{name}")
        self.log("delete", name=name)

    # Running and releasing.

    def collect(self, frame):
        """Judge a frame's result and register it; its rows are still computed lazily."""
        names = getattr(frame.provenance, "sources", None)
        if names is not None and all(self.artifact(n).policy.safe_zone == TrueRule() for n in names):
            verdict, policy = judge({}, self.user)  # nothing is asked of the rows, so they need not be counted
        else:
            verdict, policy = judge({n: (self.artifact(n).policy, stats) for n, stats in frame.provenance().items()}, self.user)
        name = uuid.uuid4().hex
        self.catalogue[name] = Artifact(frame.df, policy, verdict, frame.blacklist, frame.query, self.user, frame.order)
        self.log("collect", name=name, query=frame.query, action=None if verdict.safe else verdict.action.name)
        return self.get_df(name)

    def release(self, name: str) -> DataFrame:
        """The sanitised rows of a collected result, or ``RequestRejected``."""
        found = self.artifact(name)
        verdict = found.verdict
        if not verdict.safe:
            if verdict.action is Action.REJECT:
                self.log("reject", name=name, reason=verdict.reason)
                raise RequestRejected(verdict.reason)
            if verdict.action is Action.REVIEW:
                request = ReviewRequest(found.query, verdict.reason, self.user, found.df.schema.simpleString())
                if self.reviews:
                    self._reviewed(name, request)
                else:
                    allowed = self.reviewer(request)
                    self.log("review", name=name, reason=verdict.reason, allowed=allowed)
                    if not allowed:
                        raise RequestRejected(verdict.reason)
            else:
                self.log("warning", name=name, reason=verdict.reason)
        return sanitise(found.df, found.blacklist)

    @property
    def review_queue(self) -> ReviewQueue:
        if not self.reviews:
            raise ValueError("the session has no folder of reviews")
        return ReviewQueue(self.spark, self.reviews)

    def _reviewed(self, name: str, request: ReviewRequest) -> None:
        """Raises unless the request was allowed; files it if there is none."""
        queue = self.review_queue
        if queue.ask(name, request):
            self.log("review asked", name=name, reason=request.reason)
        state = queue.state(name)
        if state == PENDING:
            raise ReviewPending(f"{name} waits for review: {request.reason}")
        self.log("review", name=name, reason=request.reason, allowed=state == ALLOWED)
        if state != ALLOWED:
            raise RequestRejected(request.reason)

    def answer(self, name: str, allow: bool, note: str = "") -> None:
        """Allow or deny a request for review (owners only)."""
        self._owned("answer requests")
        self.review_queue.answer(name, allow, self.user, note)
        self.log("answer", name=name, allow=allow)

    def fetch(self, name: str, timeout: float = 0.0, delay: float = 0.2) -> DataFrame | None:
        """As ``release``, but None for a rejected request, or for one that still waits for review after ``timeout`` seconds."""
        until = time.monotonic() + timeout
        while True:
            try:
                return self.release(name)
            except ReviewPending:
                if time.monotonic() >= until:
                    return None
                time.sleep(delay)
            except RequestRejected:
                return None

    # Persistence.

    def save(self, name: str) -> None:
        found = self.artifact(name)
        if not found.policy.savable:
            raise RequestRejected("the policy does not allow saving")
        if not self.store:
            raise ValueError("the session has no store")
        folder = f"{self.store}/{name}"
        found.df.write.mode("overwrite").parquet(f"{folder}/data")
        about = {
            "policy": found.policy.to_json(), "action": None if found.verdict.safe else found.verdict.action.name, "reason": found.verdict.reason,
            "blacklist": sorted(found.blacklist), "query": found.query, "owner": found.owner, "order": list(found.order),
        }
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")
        self.log("save", name=name)

    def _reload(self) -> None:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.store)
        system = hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for entry in system.listStatus(hadoop_path) if system.exists(hadoop_path) else []:
            name = entry.getPath().getName()
            about = json.loads(self.spark.read.text(f"{self.store}/{name}/about").first()["value"])
            verdict = Verdict() if about["action"] is None else Verdict(Action[about["action"]], about["reason"])
            df = self.spark.read.parquet(f"{self.store}/{name}/data")
            self.catalogue[name] = Artifact(df, Policy.from_json(about["policy"]), verdict, frozenset(about["blacklist"]), about["query"], about["owner"], tuple(about["order"]))


def sanitise(df: DataFrame, blacklist: frozenset[str]) -> DataFrame:
    """Sensitive columns become null, with their type."""
    return df.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in blacklist else F.col(f"`{f.name}`") for f in df.schema])


