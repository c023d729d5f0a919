"""URL filters by a sort-merge range join (operator 7, native).

A host is written with its labels reversed and a closing dot (``www.example.com`` becomes
``com.example.www.``), so a rule's host covers exactly the keys that start with its own key: the
half-open interval [``com.example.``, ``com.example/``), because ``/`` follows ``.`` in byte order.
Intervals of hosts are nested or disjoint. Their end points and the url keys are sorted together
over range partitions; each end point carries the stack of rules that are open behind it, and a url
takes the stack of the last end point before it. What crosses a partition's edge is one end point
per partition. The path test and "longest rule wins" are then local to the row.

Skew: a hot host is one key, so a hash of the url and its row id take part in the sort and the range
partitions cut through the host. Rules never multiply urls: each url row stays one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import shuffle_partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<size:int,host_size:int,blocks:int,host:string,path:string,action:string>>"


def _after_scheme(url):
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url):
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url):
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    """Labels reversed, each closed by a dot: a prefix of the key is a suffix of the host."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def rule_events(rules: DataFrame) -> DataFrame:
    """End points of the rules' host intervals, each with the stack of rules open behind it.

    One event per distinct host and end. The stack of a host holds the rules of that host and of
    its parent hosts, found by an equality join on the parent hosts (a host has few labels).
    """
    r = rules.select(F.col("action"), F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
                     F.coalesce("path", F.lit("")).alias("path")).where("host <> ''").distinct()
    labels = F.split("host", "\\.")
    hosts = r.select("host").distinct().select(
        F.col("host").alias("of"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                              lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("host"))
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
                    (F.col("action") == "block").cast("int").alias("blocks"), "host", "path", "action")
    stacks = hosts.join(r, "host").groupBy("of").agg(F.collect_list(rule).alias("stack"))
    start = stacks.select(host_key(F.col("of")).alias("key"), "stack")
    end = stacks.select(F.concat(F.array_join(F.reverse(F.split("of", "\\.")), "."), F.lit("/")).alias("key"),
                        F.filter("stack", lambda x: x["host"] != F.col("of")).alias("stack"))
    return start.unionByName(end).select("key", F.col("stack").cast(STACK).alias("stack"))


def url_filter(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``urls``.

    A rule (action, host, path) fits its host and all subdomains if the url's path starts with the
    rule's path; the longest rule (host and path together, then host) wins, ``block`` before
    ``allow`` if the same rule says both. ``rule`` is host and path together, null if none fits;
    the verdict is then ``default``. Null urls and urls without ``://`` have an empty host and path
    and get ``default``. Repeated rows and null ids are kept as they are; other columns are not
    read. An empty table gives an empty result.
    """
    u = urls.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    points = (u.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("is_url"),
                       F.xxhash64("path", "id").alias("salt"), "id", "host", "path",
                       F.lit(None).cast(STACK).alias("stack"))
              .unionByName(rule_events(rules).withColumns({
                  "is_url": F.lit(0), "salt": F.lit(0).cast("long"), "id": F.lit(None).cast(u.schema["id"].dataType),
                  "host": F.lit(None).cast("string"), "path": F.lit(None).cast("string")})))
    n = shuffle_partitions(urls.sparkSession)
    parts = written(points.repartitionByRange(n, "key", "is_url", "salt")
                    .withColumn("part", F.spark_partition_id()), "url-points")
    # the last end point of each partition, carried over partitions without one: n rows at most
    last = (parts.groupBy("part").agg(F.max_by("stack", F.when(F.col("is_url") == 0, F.col("key"))).alias("last")))
    carried = last.select(F.col("part"), F.last("last", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "is_url", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = (parts.withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
             .where("is_url = 1").join(F.broadcast(carried), "part", "left")
             .withColumn("open", F.coalesce("open", "carried")))
    best = F.array_max(F.filter("open", lambda r: F.col("path").startswith(r["path"])))
    return (swept.withColumn("best", best)
            .select(F.col("id").alias(id_col), "host", "path",
                    F.concat(F.col("best.host"), F.col("best.path")).alias("rule"),
                    F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict")))
