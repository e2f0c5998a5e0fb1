"""Snapshot filters, id lookup, grouping, top-n and object listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.glob import matches_list, validate
from palimpsest.functions.scalar import short_id
from palimpsest.model import RepositoryError


def host_in(hosts: Sequence[str]) -> Column:
    """No hosts: every host."""
    return F.col("hostname").isin(list(hosts)) if hosts else F.lit(True)


def has_tags(tags: Sequence[str]) -> Column:
    """All tags, in order; "" is met at once by a snapshot without tags, whatever follows."""
    own = F.coalesce("tags", F.array().cast("array<string>"))
    out = F.lit(True)
    for tag in reversed(tags):
        out = F.array_contains(own, tag) & out
        if tag == "":
            out = (F.size(own) == 0) | out
    return out


def tags_in(lists: Sequence[Sequence[str]]) -> Column:
    """Any of the lists; no lists: every snapshot."""
    out = F.lit(not lists)
    for tags in lists:
        out = out | has_tags(tags)
    return out


def paths_in(paths: Sequence[str]) -> Column:
    """All the paths."""
    out = F.lit(True)
    for p in paths:
        out = out & F.array_contains(F.coalesce("paths", F.array().cast("array<string>")), p)
    return out


def find_snapshots(snapshots: DataFrame, hosts: Sequence[str] = (), tags: Sequence[Sequence[str]] = (), paths: Sequence[str] = (), until: str | None = None) -> DataFrame:
    """Snapshots that meet every filter; ``until`` drops later ones only."""
    out = snapshots.where(host_in(hosts) & tags_in(tags) & paths_in(paths))
    return out if until is None else out.where(F.col("time") <= F.lit(until).cast("timestamp"))


def split_id(text: str, several: bool = False) -> tuple[str, str]:
    """id and subfolder of "id:subfolder", which isn't allowed where several snapshots are."""
    own, _, folder = text.partition(":")
    if several and folder:
        raise RepositoryError(f"{text}: a subfolder is not allowed here")
    return own, folder.strip("/")


def resolve_id(objects: DataFrame, prefix: str, id_col: str = "id") -> str:
    """The one id that starts with a prefix; none and several are different errors."""
    found = [r[0] for r in objects.select(id_col).where(F.col(id_col).startswith(prefix)).distinct().limit(2).collect()]
    if not found:
        raise RepositoryError(f"no matching id found for prefix {prefix!r}")
    if len(found) > 1:
        raise RepositoryError(f"multiple ids match prefix {prefix!r}")
    return found[0]


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot; of equal times the largest id."""
    return snapshots.orderBy(F.col("time").desc(), F.col("id").desc()).limit(1)


def explicit(snapshots: DataFrame, ids: Sequence[str], **filters) -> DataFrame:
    """Snapshots named by (prefixes of) ids or "latest", each once, with their order in ``nr``.

    Filters apply to "latest" only; used without it they are an error.
    """
    if any(filters.values()) and "latest" not in ids:
        raise RepositoryError("explicit snapshot ids are given, filters are ignored")
    found: list[str] = []
    for text in ids:
        own, _ = split_id(text, several=True)
        if own == "latest":
            got = latest(find_snapshots(snapshots, **filters)).select("id").collect()
            if not got:
                raise RepositoryError("no snapshot found")
            own = got[0][0]
        else:
            own = resolve_id(snapshots, own)
        if own not in found:
            found.append(own)
    order = snapshots.sparkSession.createDataFrame([(x, i) for i, x in enumerate(found)], "id string, nr int")
    return snapshots.join(F.broadcast(order), "id").orderBy("nr")  # as many rows as ids were typed


def default_hosts(given: Sequence[str] | None, environment: str | None) -> list[str]:
    """The environment's host unless hosts are given; [""] clears both."""
    hosts = list(given) if given is not None else [environment] if environment else []
    return [] if hosts == [""] else hosts


def parse_group_by(text: str) -> tuple[bool, bool, bool]:
    """(host, path, tag) of a comma-separated list; singular and plural mean the same."""
    parts = [p for p in text.split(",") if p]
    kinds = [p.removesuffix("s") for p in parts]
    if bad := [p for p, k in zip(parts, kinds, strict=True) if k not in ("host", "path", "tag")]:
        raise RepositoryError(f"unknown grouping {bad[0]!r}")
    return "host" in kinds, "path" in kinds, "tag" in kinds


def group_columns(by: str = "host,paths") -> list[Column]:
    """group_host, group_paths, group_tags; parts not grouped by are null. Null and empty lists differ."""
    host, path, tag = parse_group_by(by)
    none = F.lit(None)
    return [
        (F.col("hostname") if host else none.cast("string")).alias("group_host"),
        (F.array_sort("paths") if path else none.cast("array<string>")).alias("group_paths"),
        (F.array_sort("tags") if tag else none.cast("array<string>")).alias("group_tags"),
    ]


GROUP = ["group_host", "group_paths", "group_tags"]


def group_snapshots(snapshots: DataFrame, by: str = "host,paths") -> DataFrame:
    """A row a group: its key, number of snapshots, first and last time."""
    return snapshots.groupBy(*group_columns(by)).agg(F.count("*").alias("snapshots"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def latest_per_group(snapshots: DataFrame, n: int, by: str = "host,paths") -> DataFrame:
    """The newest n of each group, numbered in ``nr``; ties by larger id first."""
    keyed = snapshots.select("*", *group_columns(by))
    order = Window.partitionBy(*GROUP).orderBy(F.col("time").desc(), F.col("id").desc())
    return keyed.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= n)


def sort_entries(entries: DataFrame, key: str = "name", reverse: bool = False) -> DataFrame:
    """Listing order: by name (as a walk goes), size, time, atime, ctime or extension, then by path."""
    from palimpsest.functions.scalar import extension

    walk = F.split("path", "/")
    keys = {"name": walk, "size": F.col("size"), "time": F.col("mtime"), "mtime": F.col("mtime"), "atime": F.col("atime") if "atime" in entries.columns else None, "ctime": F.col("ctime") if "ctime" in entries.columns else None, "extension": extension(F.col("path"))}
    if keys.get(key) is None:
        raise RepositoryError(f"can't sort by {key!r}")
    down = lambda c: c.desc() if reverse else c.asc()
    return entries.orderBy(down(keys[key]), walk.asc() if key != "name" else down(walk))


def list_objects(objects: DataFrame, kind: str) -> DataFrame:
    """Ids of one type, or of all blobs of an index, repeats included."""
    if kind == "blobs":
        return objects.select("blob_type", "blob_id")
    return objects.where(F.col("type") == kind).select("id")


def object_json(objects: DataFrame, id_: str, id_col: str = "id") -> str:
    """One object as JSON."""
    full = resolve_id(objects, id_, id_col)
    return objects.where(F.col(id_col) == full).select(F.to_json(F.struct("*"))).first()[0]


def listing(snapshots: DataFrame) -> DataFrame:
    """Snapshots as they are printed, oldest first."""
    return snapshots.select(short_id(F.col("id")).alias("short_id"), "time", "hostname", F.array_join("tags", ",").alias("tags"), F.array_join("paths", ",").alias("paths")).orderBy("time", "short_id")


def select_attributes(nodes: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Nodes with the extended attributes whose names match an included pattern, or no excluded one; all if neither is given."""
    if include and exclude:
        raise RepositoryError("exclude and include patterns of attributes are mutually exclusive")
    validate(list(include or exclude))
    if not include and not exclude:
        return nodes
    keep = lambda x: matches_list(x["name"], list(include)) if include else ~matches_list(x["name"], list(exclude))
    return nodes.withColumn("extended_attributes", F.filter("extended_attributes", keep))
