"""Virtual repositories over the star-schema tables, for queries without a real store.

Snapshots come from events (one an event) and orders (one an order, with ties in time); trees
go region, nation, customer, order; an order's file content is the parts of its lines; the
index holds every (part, supplier) pair as a copy of the part's blob in the supplier's pack, so
blobs have several copies. Packs are listed with a few faults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.scalar import entry_length
from palimpsest.model import CRYPTO, HEADER, with_checkpoints


class Virtual:
    """Lazy tables of the virtual repository of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def snapshots(self) -> DataFrame:
        """From events: hosts, one or two tags or none, days of one month."""
        e = self.table("events")
        tags = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array("event_type"))
        return e.select(
            F.sha2(F.concat(F.lit("event"), F.col("event_id").cast("string")), 256).alias("id"),
            F.col("event_id").alias("pos"),
            F.col("ts").alias("time"),
            F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("hostname"),
            F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("username"),
            F.array(F.concat(F.lit("/srv/"), F.col("event_type")), F.concat(F.lit("/d"), (F.col("event_id") % 3).cast("string"))).alias("paths"),
            tags.alias("tags"),
        )

    def order_snapshots(self) -> DataFrame:
        """From orders: years of days, with several at one time."""
        o = self.table("orders")
        return o.select(
            F.sha2(F.concat(F.lit("order"), F.col("o_orderkey").cast("string")), 256).alias("id"),
            F.col("o_orderkey").alias("pos"),
            F.col("o_orderdate").alias("time"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("hostname"),
            F.array(F.concat(F.lit("/p"), (F.col("o_custkey") % 3).cast("string"))).alias("paths"),
            F.array("o_orderstatus", "o_orderpriority").alias("tags"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("tree"),
        )

    def root_snapshots(self) -> DataFrame:
        """One snapshot a region, and one of everything."""
        r = self.table("region")
        one = r.select(F.concat(F.lit("region"), F.col("r_regionkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("tree"))
        return one.union(self.spark.createDataFrame([("all", "root")], "id string, tree string"))

    def nodes(self, until: str | None = None, lines_until: str | None = None) -> DataFrame:
        """All tree nodes; with ``until`` only orders before that day, with ``lines_until`` only lines shipped before."""
        text = lambda c: F.col(c).cast("string")
        key = lambda lead, c: F.concat(F.lit(lead), text(c))

        def dirs(table: str, tree, name: str, sub) -> DataFrame:
            return self.table(table).select(
                tree.alias("tree_id"), F.col(name).alias("name"), F.lit("dir").alias("type"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"),
                F.lit(0).cast("long").alias("inode"), F.lit(0).cast("long").alias("device_id"), F.lit(1).cast("long").alias("links"), F.lit(None).cast("array<string>").alias("content"), sub.alias("subtree"),
            )

        o, line = self.table("orders"), self.table("lineitem")
        if until:
            o = o.where(F.col("o_orderdate") < until)
        if lines_until:
            line = line.where(F.col("l_shipdate") < lines_until)
        content = line.groupBy("l_orderkey").agg(
            F.sum("l_quantity").cast("long").alias("size"),
            F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("b"), x.l_partkey.cast("string"))).alias("content"),
        )
        k = F.col("o_orderkey")
        files = o.join(content, k == F.col("l_orderkey"), "left").select(
            key("c", "o_custkey").alias("tree_id"),
            F.concat(F.lit("o"), text("o_orderkey"), F.lit("."), F.lower("o_orderstatus")).alias("name"),
            F.when(k % 50 == 0, "symlink").otherwise("file").alias("type"),
            F.coalesce("size", F.lit(0).cast("long")).alias("size"),
            F.col("o_orderdate").alias("mtime"),
            F.when(k % 3 == 0, F.floor(k / 8) + 1).otherwise(F.lit(0)).cast("long").alias("inode"),
            (F.col("o_custkey") % 2).alias("device_id"),
            F.when(k % 3 == 0, 2).otherwise(1).cast("long").alias("links"),
            F.when(k % 50 == 0, F.lit(None)).otherwise(F.coalesce("content", F.array().cast("array<string>"))).alias("content"),
            F.lit(None).cast("string").alias("subtree"),
        )
        out = dirs("region", F.lit("root"), "r_name", key("r", "r_regionkey"))
        out = out.union(dirs("nation", key("r", "n_regionkey"), "n_name", key("n", "n_nationkey")))
        return out.union(dirs("customer", key("n", "c_nationkey"), "c_name", key("c", "c_custkey"))).union(files)

    def stored_nodes(self, **until: str) -> DataFrame:
        """The same, written once, for operators that read nodes level by level."""
        with_checkpoints(self.spark)
        return self.nodes(**until).checkpoint()

    def index_blobs(self) -> DataFrame:
        """Data blobs with copies in several packs, and one tree blob for each tree."""
        p = F.col("p_partkey")
        pairs = self.table("lineitem").select("l_partkey", "l_suppkey").distinct().join(self.table("part"), F.col("l_partkey") == p)
        data = pairs.select(
            F.concat(F.lit("i"), (F.col("l_suppkey") % 7).cast("string")).alias("index_id"),
            F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("pack_id"),
            F.lit("data").alias("blob_type"),
            F.concat(F.lit("b"), p.cast("string")).alias("blob_id"),
            (CRYPTO + 68 + F.col("p_size").cast("long") * 37).alias("length"),
            F.when(p % 3 == 0, 0).otherwise(150 + F.col("p_size").cast("long") * 80).cast("long").alias("uncompressed_length"),
        )
        trees = self.nodes().where("subtree IS NOT NULL").select("subtree").union(self.spark.createDataFrame([("root",)], "subtree string"))
        number = F.coalesce(F.substring("subtree", 2, 20).try_cast("long"), F.lit(0))
        tree = trees.select(
            F.lit("i0").alias("index_id"), F.concat(F.lit("t"), (number % 10).cast("string")).alias("pack_id"), F.lit("tree").alias("blob_type"),
            F.col("subtree").alias("blob_id"), F.lit(200).cast("long").alias("length"), F.lit(400).cast("long").alias("uncompressed_length"),
        )
        return data.union(tree)

    def packs(self) -> DataFrame:
        """A listing of packs: some missing, some of another size, and two that no index names."""
        size = self.index_blobs().groupBy("pack_id").agg((HEADER + F.sum(F.col("length") + entry_length(F.col("uncompressed_length")))).alias("size"))
        n = F.substring("pack_id", 2, 20).cast("long")
        listed = size.where((n % 11 != 0) | F.col("pack_id").startswith("t")).select("pack_id", (F.col("size") + F.when(n % 13 == 5, 5).otherwise(0)).alias("size"))
        return listed.union(self.spark.createDataFrame([("z1", 1000), ("z2", 2000)], "pack_id string, size bigint"))


#: The same views for DuckDB; ``with_views`` puts those that a query names before it.
SQL_VIEWS = {
    "snapshots": """SELECT sha256('event' || event_id) AS id, event_id AS pos, ts AS time, 'h' || user_id AS hostname, 'u' || user_id % 7 AS username,
        ['/srv/' || event_type, '/d' || event_id % 3] AS paths,
        CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN [event_type, 'x'] ELSE [event_type] END AS tags FROM events""",
    "order_snapshots": """SELECT sha256('order' || o_orderkey) AS id, o_orderkey AS pos, o_orderdate AS time, 'c' || o_custkey AS hostname, ['/p' || o_custkey % 3] AS paths,
        [o_orderstatus, o_orderpriority] AS tags, 'c' || o_custkey AS tree FROM orders""",
    "root_snapshots": "SELECT 'region' || r_regionkey AS id, 'r' || r_regionkey AS tree FROM region UNION ALL SELECT 'all', 'root'",
    "contents": """SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS size, list('b' || l_partkey ORDER BY l_linenumber, l_partkey) AS content FROM lineitem GROUP BY l_orderkey""",
    "nodes": """SELECT 'root' AS tree_id, r_name AS name, 'dir' AS type, CAST(0 AS BIGINT) AS size, CAST(NULL AS TIMESTAMP) AS mtime, CAST(0 AS BIGINT) AS inode, CAST(0 AS BIGINT) AS device_id, CAST(1 AS BIGINT) AS links, CAST(NULL AS VARCHAR[]) AS content, 'r' || r_regionkey AS subtree FROM region
        UNION ALL SELECT 'r' || n_regionkey, n_name, 'dir', 0, NULL, 0, 0, 1, NULL, 'n' || n_nationkey FROM nation
        UNION ALL SELECT 'n' || c_nationkey, c_name, 'dir', 0, NULL, 0, 0, 1, NULL, 'c' || c_custkey FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey || '.' || lower(o_orderstatus), CASE WHEN o_orderkey % 50 = 0 THEN 'symlink' ELSE 'file' END, coalesce(size, 0), o_orderdate,
            CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 8 + 1 ELSE 0 END, o_custkey % 2, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END,
            CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE coalesce(content, []) END, NULL FROM orders LEFT JOIN contents ON o_orderkey = l_orderkey""",
    "walk": """SELECT s.id AS snapshot_id, '/' || n.name AS path, 1 AS depth, n.* FROM root_snapshots s JOIN nodes n ON n.tree_id = s.tree
        UNION ALL SELECT w.snapshot_id, w.path || '/' || n.name, w.depth + 1, n.* FROM walk w JOIN nodes n ON w.subtree = n.tree_id""",
    "index_blobs": """SELECT 'i' || l_suppkey % 7 AS index_id, 'p' || l_suppkey AS pack_id, 'data' AS blob_type, 'b' || p_partkey AS blob_id, 100 + CAST(p_size AS BIGINT) * 37 AS length,
            CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 150 + CAST(p_size AS BIGINT) * 80 END AS uncompressed_length
            FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey
        UNION ALL SELECT 'i0', 't' || coalesce(TRY_CAST(substr(subtree, 2) AS BIGINT), 0) % 10, 'tree', subtree, 200, 400 FROM (SELECT subtree FROM nodes WHERE subtree IS NOT NULL UNION ALL SELECT 'root')""",
    "pack_sizes": "SELECT pack_id, CAST(36 + sum(length + CASE WHEN uncompressed_length > 0 THEN 41 ELSE 37 END) AS BIGINT) AS size FROM index_blobs GROUP BY pack_id",
    "packs": """SELECT pack_id, size + CASE WHEN CAST(substr(pack_id, 2) AS BIGINT) % 13 = 5 THEN 5 ELSE 0 END AS size FROM pack_sizes
            WHERE CAST(substr(pack_id, 2) AS BIGINT) % 11 <> 0 OR pack_id LIKE 't%'
        UNION ALL VALUES ('z1', 1000), ('z2', 2000)""",
}


def with_views(sql: str, **more: str) -> str:
    """A query with the views that it uses, and those they use, before it."""
    import re

    views: dict[str, str] = SQL_VIEWS | more
    order: list[str] = []

    def put(text: str, own: str = "") -> None:
        for name, view in views.items():
            if name != own and name not in order and re.search(rf"\b{name}\b", text):
                put(view, name)
                order.append(name)

    put(sql)
    if not order:
        return sql
    once = "MATERIALIZED "
    own = ", ".join(f"{n} AS {once}({views[n].removeprefix(once)})" if views[n].startswith(once) else f"{n} AS ({views[n]})" for n in order)
    body = sql.strip()
    return f"WITH RECURSIVE {own}, {body[5:]}" if body.startswith("WITH ") else f"WITH RECURSIVE {own} {body}"
