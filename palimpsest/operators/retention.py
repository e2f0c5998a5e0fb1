"""Retention policies: which snapshots stay, and why. Window functions only.

A counted rule keeps the first snapshot, from the newest on, of each run with one calendar
value, up to its count, and the oldest snapshot while count is left. Runs rather than distinct
values make this right in any time zone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.durations import Duration, before
from palimpsest.model import RepositoryError
from palimpsest.operators.select import GROUP, group_columns, has_tags

COUNTED = ("last", "hourly", "daily", "weekly", "monthly", "yearly")
UNLIMITED = -1


@dataclass(frozen=True)
class Policy:
    """Counts (-1: all), durations and tag lists; a snapshot stays if any of them says so."""

    last: int = 0
    hourly: int = 0
    daily: int = 0
    weekly: int = 0
    monthly: int = 0
    yearly: int = 0
    within: Duration = Duration()
    within_hourly: Duration = Duration()
    within_daily: Duration = Duration()
    within_weekly: Duration = Duration()
    within_monthly: Duration = Duration()
    within_yearly: Duration = Duration()
    tags: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if any(getattr(self, n) < UNLIMITED for n in COUNTED):
            raise RepositoryError("negative counts are not allowed")
        if any(getattr(self, n).negative for n in self._durations()):
            raise RepositoryError("durations with negative parts are not allowed")

    @staticmethod
    def _durations() -> list[str]:
        return ["within", *(f"within_{n}" for n in COUNTED[1:])]

    @property
    def empty(self) -> bool:
        return not (any(getattr(self, n) for n in (*COUNTED, *self._durations())) or self.tags)

    def __str__(self) -> str:
        count = lambda n: "all" if n < 0 else str(n)
        counts = ", ".join(f"{count(n)} {'latest' if name == 'last' else name}" for name in COUNTED if (n := getattr(self, name)))
        spans = ", ".join(f"{name} snapshots within {d}" for name in COUNTED[1:] if (d := getattr(self, f"within_{name}")))
        first = ", ".join(x for x in (counts and counts + " snapshots", spans) if x)
        tags = self.tags and f"all snapshots with tags [{' '.join('[' + ', '.join(t) + ']' for t in self.tags)}]"
        newest = self.within and f"all snapshots within {self.within} of the newest"
        said = " and ".join(x for x in (first, tags, newest) if x)
        return f"keep {said}" if said else "remove"


def _value(name: str, time: Column) -> Column:
    return {
        "last": F.col("pos").cast("string"),
        "hourly": F.date_format(time, "yyyyMMddHH"),
        "daily": F.date_format(time, "yyyyMMdd"),
        "weekly": (F.extract(F.lit("YEAROFWEEK"), time) * 100 + F.weekofyear(time)).cast("string"),
        "monthly": F.date_format(time, "yyyyMM"),
        "yearly": F.date_format(time, "yyyy"),
    }[name]


def apply_policy(snapshots: DataFrame, policy: Policy, by: list[str] = (), now: str | None = None) -> DataFrame:
    """Every snapshot with kept, reasons and the counters left after it.

    ``snapshots`` has time and pos; pos breaks ties (smaller first) in an order newest
    first. ``local_time``, if there, is the time in the snapshot's own zone, by which
    calendar values go. ``by`` names grouping columns. The newest time that is not after ``now``
    is what durations count back from.
    """
    local = F.col("local_time" if "local_time" in snapshots.columns else "time")
    order = Window.partitionBy(*by).orderBy(F.col("time").desc(), "pos")
    whole = Window.partitionBy(*by)
    present = F.when(F.col("time") <= F.lit(now).cast("timestamp"), F.col("time")) if now else F.col("time")
    oldest = F.lead(F.lit(False), 1, True).over(order)
    columns = {"_oldest": oldest, "_newest": F.max(present).over(whole)}
    names = [n for n in COUNTED if getattr(policy, n) or (n != "last" and getattr(policy, f"within_{n}"))]
    for n in names:
        value = _value(n, local)
        columns[f"_start_{n}"] = F.coalesce(value != F.lag(value).over(order), F.lit(True))
    df = snapshots.withColumns(columns)
    df = df.withColumns({f"_run_{n}": F.sum(F.col(f"_start_{n}").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) for n in names if getattr(policy, n)})
    reasons: list[Column] = []
    for tags in policy.tags:
        reasons.append(F.when(has_tags(tags), f"has tags [{', '.join(tags)}]"))
    if policy.within:
        reasons.append(F.when(F.col("time") > before(F.col("_newest"), policy.within), f"within {policy.within}"))
    counters = []
    for n in COUNTED:
        limit = getattr(policy, n)
        if not limit:
            counters.append(F.lit(0).cast("long").alias(n))
            continue
        start, run = F.col(f"_start_{n}"), F.col(f"_run_{n}")
        first = start & (F.lit(limit < 0) | (run <= limit))
        extra = F.col("_oldest") & ~start & (F.lit(limit < 0) | (run < limit))
        text = f"{n} snapshot"
        reasons.append(F.when(extra, f"oldest {text}").when(first, text))
        left = F.lit(limit) if limit < 0 else F.greatest(limit - run - extra.cast("int"), F.lit(0))
        counters.append(left.cast("long").alias(n))
    for n in COUNTED[1:]:
        d = getattr(policy, f"within_{n}")
        if d:
            inside = F.col("time") > before(F.col("_newest"), d)
            start = F.col(f"_start_{n}")
            reasons.append(F.when(inside & F.col("_oldest") & ~start, f"oldest {n} within {d}").when(inside & start, f"{n} within {d}"))
    listed = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    df = df.withColumn("reasons", listed).withColumn("kept", F.size("reasons") > 0).withColumn("counters", F.struct(*counters))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def forget(snapshots: DataFrame, policy: Policy, by: str = "host,paths", now: str | None = None, unsafe: bool = False, filtered: bool = False) -> DataFrame:
    """The policy applied to each group: group key, snapshot, action (keep or remove), reasons.

    An empty policy would remove everything and needs ``unsafe`` and a filter. A group that would be
    left empty is an error unless ``unsafe``; that check reads the result once.
    """
    if policy.empty and not (unsafe and filtered):
        raise RepositoryError("no policy was given; removing all snapshots needs an explicit permission and a filter")
    keyed = snapshots.select("*", *group_columns(by))
    out = apply_policy(keyed, policy, by=GROUP, now=now).withColumn("action", F.when(F.col("kept"), "keep").otherwise("remove"))
    if not unsafe and not out.groupBy(*GROUP).agg(F.max("kept").alias("any")).where("NOT any").isEmpty():
        raise RepositoryError("refusing to delete the last snapshot of a group")
    return out
