"""A ledger of work items: each is taken by exactly one successful run, whatever fails in between.

Items are pending, leased or done. A run leases what is pending (or whose lease has run out) under a fencing token,
writes its results to paths that follow from the items alone, and then commits. A commit counts only for items whose
latest lease carries the committer's token and hasn't run out, so a run that was thought dead and comes back changes
nothing. These rules stand once, in ``step``: the log of finished runs is replayed with it, and the live ledger, too,
tells the state of an item by folding its events with it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.sources.files import create_once, list_names, read_text

#: Runs are rows of an operation log; more than this many and the join is left to the optimizer instead of broadcast.
BROADCAST_RUNS = 200_000
DAY_US = 86_400_000_000

#: What is known of an item: the run and token of its latest lease, when that runs out, all its tokens, and commits refused.
STATE = "struct<done:boolean,token:bigint,until:bigint,run:string,tokens:array<bigint>,refused:int>"
#: What happens to items: a lease or a commit, or a state that was written down (base) and counts in place of all before it.
EVENT = f"struct<seq:bigint,kind:string,at:bigint,token:bigint,until:bigint,run:string,base:{STATE}>"


def pending() -> Column:
    return F.struct(F.lit(False).alias("done"), F.lit(-1).alias("token"), F.lit(0).alias("until"), F.lit("").alias("run"), F.array().alias("tokens"), F.lit(0).alias("refused")).cast(STATE)


def step(acc: Column, e: Column) -> Column:
    """The state after an event. Times and ``until`` are of one unit; a lease holds while until > at, and a commit counts
    up to and at ``until``. A commit of a run that never leased the item isn't about it."""
    free = ~acc["done"] & ((acc["token"] < 0) | (acc["until"] <= e["at"]))
    taken = F.struct(acc["done"].alias("done"), e["token"].alias("token"), e["until"].alias("until"), e["run"].alias("run"), F.array_append(acc["tokens"], e["token"]).alias("tokens"), acc["refused"].alias("refused")).cast(STATE)
    good = ~acc["done"] & (acc["token"] == e["token"]) & (e["at"] <= acc["until"])
    known = F.array_contains(acc["tokens"], e["token"])
    after = acc.withField("done", acc["done"] | good).withField("refused", acc["refused"] + (known & ~good).cast("int"))
    return F.when((e["kind"] == "lease") & free, taken).when((e["kind"] == "commit") & known, after).when(e["kind"] == "base", e["base"]).otherwise(acc).cast(STATE)


def folded(events: Column) -> Column:
    """The state after all events, in order of their numbers."""
    return F.aggregate(F.array_sort(events), pending(), step)


def version_key(df: DataFrame) -> Column:
    """What tells versions of an object apart: its version id, or for unversioned objects the second of last_modified."""
    own = F.trim(F.col("version_id"))
    named = F.when((own != "") & (F.lower(own) != "null"), F.concat(F.lit("v:"), own))
    second = F.date_trunc("second", F.col("last_modified"))
    return F.coalesce(named, F.concat(F.lit("t:"), F.coalesce(F.unix_seconds(second).cast("string"), F.lit("-"))))


def object_versions(deliveries: DataFrame) -> DataFrame:
    """object_key, version_key, delivery_id, delivered_at: one row per version of a file, from its first delivery.

    Rows without key don't count. A version whose deliveries all lack a time keeps a null time and stays pending.
    """
    first = F.struct(F.unix_micros("delivered_at").alias("us"), F.col("delivery_id").alias("id"))
    dated = F.min(F.when(F.col("delivered_at").isNotNull(), first))
    rows = deliveries.where((F.col("kind") == "File") & F.col("object_key").isNotNull())
    rows = rows.select("object_key", version_key(rows).alias("version_key"), "delivery_id", "delivered_at")
    found = rows.groupBy("object_key", "version_key").agg(dated.alias("first"), F.min("delivery_id").alias("any_id"))
    return found.select(
        "object_key", "version_key", F.coalesce("first.id", "any_id").alias("delivery_id"), F.timestamp_micros("first.us").alias("delivered_at")
    )


def run_outcomes(runs: DataFrame, status: str = "run_status", started: str = "started_at", finished: str = "finished_at", run_id: str = "run_id") -> DataFrame:
    """run, start, before (start of the run before), outcome (STATE): what becomes of items for which a run is the first to come.

    The log is replayed as lease and commit events. A run leases at its start, under its ordinal as token. One that
    succeeded renews its lease until it commits, at its end. One that failed or was killed stops renewing: its lease runs
    out at its end, or when the next run starts. It then comes back, once the next run has taken its leases, and tries to
    commit all the same, which the ledger must refuse. All items that came between the same two starts share their
    events, so these are folded once for each run and not for each item; runs are grouped by the next one that succeeds,
    after whose commit nothing can change, so that a fold is as long as a series of failures. Runs without start or id
    are ignored; a missing end is the start. The log alone (not the items) is put in order in one task, as rows of some 50
    bytes.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    log = runs.where(F.col(started).isNotNull() & F.col(run_id).isNotNull())
    if finished not in runs.columns:
        log = log.withColumn(finished, F.col(started))
    log = log.select(F.col(run_id).alias("run"), micros(started).alias("start"), F.coalesce(F.greatest(micros(finished), micros(started)), micros(started)).alias("end"), F.coalesce(F.col(status) == "succeeded", F.lit(False)).alias("good"))
    order = Window.orderBy("start", "run")
    log = log.select("*", F.row_number().over(order).cast("long").alias("token"), F.lag("start").over(order).alias("before"), F.lead("start").over(order).alias("next"), F.coalesce(F.sum(F.col("good").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("block"))
    until = F.when(F.col("good"), F.col("end")).otherwise(F.least("end", F.coalesce("next", "end")))
    back = F.when(F.col("good"), F.col("end")).otherwise(F.greatest(until, F.coalesce("next", until)) + 1)
    # ties in time: a lease after what came before it, a commit of a run that began later after those of earlier ones
    event = lambda kind, at: F.struct(F.lit(0).alias("seq"), F.lit(kind).alias("kind"), at.alias("at"), F.col("token").alias("token"), until.alias("until"), F.col("run").cast("string").alias("run"), F.lit(None).cast(STATE).alias("base")).cast(EVENT)
    both = log.select("*", F.explode(F.array(event("lease", F.col("start")), event("commit", back))).alias("event"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("event.at", "event.token", F.col("event.kind").desc())).cast("long")
    placed = both.select("block", F.col("event").withField("seq", place).alias("event"))
    series = placed.groupBy("block").agg(F.collect_list("event").alias("events"))
    met = log.select("block", "run", "start", "before", "token").join(series, "block")
    own = F.filter("events", lambda e: e["token"] >= F.col("token"))
    return met.select("run", "start", "before", folded(own).alias("outcome"))


def lease_history(items: DataFrame, available: str, runs: DataFrame, status: str = "run_status", started: str = "started_at", finished: str = "finished_at", run_id: str = "run_id") -> DataFrame:
    """The items with the ledger's state after all runs of the log have been replayed (run_outcomes).

    Adds state, first_run (the first to lease the item), done_run and token (whose commit counted), n_leases, n_refused
    (commits of runs whose lease had run out or passed to another). Items that no run has started after are pending, as
    are those only leased by runs that didn't succeed, with their count of leases. Items without a time stay pending.

    The runs' intervals are cut into days, and items find theirs by an equi-join on the day: items aren't shuffled while
    the log is within its checked bound.
    """
    kind = dict(runs.dtypes)[run_id]
    log = runs.where(F.col(started).isNotNull() & F.col(run_id).isNotNull())
    bounds = log.agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros(started)).alias("first"), F.max(F.unix_micros(started)).alias("last")).first()
    day = lambda c: F.floor(c / F.lit(DAY_US))
    spans = run_outcomes(runs, status, started, finished, run_id).select(F.col("run").alias("__run"), F.col("start").alias("__start"), F.col("before").alias("__before"), F.col("outcome").alias("__outcome"))
    spans = spans.withColumn("__day", F.explode(F.sequence(day(F.coalesce("__before", "__start")), day(F.col("__start")))))
    if (bounds["n"] or 0) + ((bounds["last"] or 0) - (bounds["first"] or 0)) // DAY_US < BROADCAST_RUNS:
        spans = F.broadcast(spans)
    at = F.unix_micros(F.col(available))
    dated = items.withColumn("__at", at).withColumn("__item_day", F.greatest(day(F.col("__at")), day(F.lit(bounds["first"] or 0))))
    dated = dated.withColumn("__item_day", F.when(F.col("__at").isNotNull(), F.col("__item_day")))
    inside = (F.col("__item_day") == F.col("__day")) & (F.col("__at") <= F.col("__start")) & (F.col("__before").isNull() | (F.col("__at") > F.col("__before")))
    found = dated.join(spans, inside, "left")
    out = F.col("__outcome")
    done = F.coalesce(out["done"], F.lit(False))
    added = {"state", "first_run", "done_run", "token", "n_leases", "n_refused"}  # columns of these names give way
    return found.select(
        *[F.col(c) for c in items.columns if c not in added], F.when(done, "done").otherwise("pending").alias("state"), F.col("__run").alias("first_run"), F.when(done, out["run"]).cast(kind).alias("done_run"),
        F.when(done, out["token"]).cast("int").alias("token"), F.coalesce(F.size(out["tokens"]), F.lit(0)).alias("n_leases"), F.coalesce(out["refused"], F.lit(0)).alias("n_refused"),
    )


def item_path(root: str, *keys: str) -> Column:
    """Where an item's result goes: it follows from the item alone, so a retry overwrites instead of adding."""
    digest = F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0001")) for k in keys]), 256)
    return F.concat(F.lit(root.rstrip("/") + "/"), F.substring(digest, 1, 2), F.lit("/"), digest)


class Ledger:
    """The same states kept in a folder, for runs that happen now.

    Item lists lie in Parquet; the order of events is a numbered log whose entries are created exclusively, so two
    writers can't take the same number (this needs a file system whose create is exclusive: HDFS, local disks, or an
    object store with conditional writes switched on). The number of a lease is its fencing token. Times are seconds,
    passed in by the caller. Anything written without its log entry (a run that died) isn't part of the ledger. All lists
    are read as one table, whose plan doesn't grow with the log; ``compact`` writes the states down, after which only
    newer events are read.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    def _log(self) -> list[dict]:
        """Entries from the last base on, in order."""
        out: list[dict] = []
        for n in sorted(list_names(self.spark, f"{self.root}/log"), reverse=True):
            out.append(json.loads(read_text(self.spark, f"{self.root}/log/{n}")))
            if out[-1]["kind"] == "base":
                break
        return out[::-1]

    def _next(self) -> int:
        return len(list_names(self.spark, f"{self.root}/log"))

    def _take(self, number: int, entry: dict) -> bool:
        return create_once(self.spark, f"{self.root}/log/{number:09d}", json.dumps(entry | {"seq": number}))

    def _record(self, entry: dict) -> int:
        """Appends; the number taken is the first one free."""
        number = self._next()
        while not self._take(number, entry):
            number += 1
        return number

    def _list(self, kind: str) -> str:
        """A new path of its own: two writers never write to the same."""
        return f"{kind}/{uuid.uuid4().hex}"

    def add(self, items: DataFrame, batch: str) -> None:
        """New pending items. The same batch again (a retry) changes nothing, nor do items that are there already."""
        if any(e["kind"] == "add" and e["batch"] == batch for e in self._log()):
            return
        path = self._list("items")
        items.select(*self.keys).distinct().write.parquet(f"{self.root}/{path}")
        self._record({"kind": "add", "batch": batch, "path": path})

    def _events(self) -> DataFrame:
        log = self._log()
        if not log:
            raise ValueError("nothing was added")
        entries = [(e["path"], e["seq"], e["kind"], int(e.get("at", 0) * 1e6), e.get("token", e["seq"]), int(e.get("until", 0) * 1e6), e.get("run", "")) for e in log if "path" in e]
        known = self.spark.createDataFrame(entries, "path string, seq long, kind string, at long, token long, until long, run string")
        schema = self.spark.read.parquet(f"{self.root}/{entries[0][0]}").select(*self.keys, F.lit(None).cast(STATE).alias("base")).schema
        lists = self.spark.read.schema(schema).parquet(*dict.fromkeys(f"{self.root}/{e[0]}" for e in entries))
        path = F.regexp_extract(F.col("_metadata.file_path"), "((?:items|leases|states)/[0-9a-f]{32})/[^/]*$", 1)
        rows = lists.select(*self.keys, "base", path.alias("path")).join(F.broadcast(known), "path")  # a row per event since the last base
        return rows.select(*self.keys, F.struct("seq", "kind", "at", "token", "until", "run", "base").cast(EVENT).alias("event"))

    def _states(self) -> DataFrame:
        # an item's events are as many as it had leases and commits since the last base
        return self._events().groupBy(*self.keys).agg(folded(F.collect_list("event")).alias("s"))

    def state(self, now: float) -> DataFrame:
        """keys, state, token, until, run, n_refused of every item."""
        state = F.when(F.col("s.done"), "done").when((F.col("s.token") >= 0) & (F.col("s.until") > int(now * 1e6)), "leased").otherwise("pending")
        return self._states().select(*self.keys, state.alias("state"), F.col("s.token").alias("token"), (F.col("s.until") / 1e6).alias("until"), F.col("s.run").alias("run"), F.col("s.refused").alias("n_refused"))

    def lease(self, run: str, now: float, seconds: float) -> int:
        """Leases all that is pending or whose lease ran out; gives the fencing token."""
        while True:
            number, path = self._next(), self._list("leases")
            self.state(now).where(F.col("state") == "pending").select(*self.keys).write.parquet(f"{self.root}/{path}")
            if self._take(number, {"kind": "lease", "run": run, "at": now, "until": now + seconds, "path": path}):
                return number
            # another writer's event came between: look again at what is pending

    def _lease_of(self, token: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.root}/log/{token:09d}"))

    def leased(self, token: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._lease_of(token)['path']}")

    def commit(self, run: str, token: int, now: float) -> DataFrame:
        """Marks the run's items done; gives those that count. Items leased anew under a higher token, and all items if the
        lease has run out by ``now``, stay untouched. A commit repeated (a retry) counts once."""
        if not any(e["kind"] == "commit" and e["token"] == token for e in self._log()):
            self._record({"kind": "commit", "run": run, "token": token, "at": now, "path": self._lease_of(token)["path"]})
        return self.state(now).where((F.col("state") == "done") & (F.col("token") == token)).select(*self.keys)

    def compact(self) -> int:
        """Writes all states down as a base, from which later reads start; gives its number. Nothing changes for callers
        but that batches added before it may be added again, which changes no item."""
        while True:
            number, path = self._next(), self._list("states")
            self._states().withColumnRenamed("s", "base").write.parquet(f"{self.root}/{path}")
            if self._take(number, {"kind": "base", "path": path}):
                return number
