"""Readings of the star-schema tables as records, claims, chains and traces.

Each property is a DataFrame over whole tables; nothing is filtered away to make it small. The same
readings are written as SQL in ``provenant.plans.model_sql`` for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators.ordered import Scan, key_sizes, numbered, scan


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- work records -------------------------------------------------------------------------------

    @cached_property
    def work(self) -> DataFrame:
        """One work record per order."""
        return self.base("orders").select(
            F.concat(F.lit("w"), "o_orderkey").alias("record_id"),
            F.col("o_orderkey").alias("seq"),
            F.col("o_orderpriority").alias("kind"),
            F.concat(F.lit("cd /c/"), "o_custkey", F.lit(" && tool"), "o_orderstatus", F.lit(" state.csv --level="),
                     F.substring("o_orderpriority", 1, 1)).alias("cmd"),
            F.concat(F.lit("env-"), F.lower("o_orderstatus")).alias("environment"),
            (F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("declared"),
            F.col("o_orderdate").cast("timestamp").alias("at"),
            F.concat(F.lit("c"), "o_custkey").alias("owner"),
            F.when(F.col("o_orderstatus") == "P", F.array(F.lit("own"), F.lit("partner")))
            .when(F.col("o_orderstatus") == "O", F.array(F.lit("partner")))
            .otherwise(F.array(F.lit("own"))).alias("registries"),
        )

    @cached_property
    def _states(self) -> DataFrame:
        orders = self.base("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return numbered(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "n")

    @cached_property
    def work_file(self) -> DataFrame:
        """Inputs and outputs: a customer's state after each order, the parts read, the suppliers written."""
        rid = F.concat(F.lit("w"), "o_orderkey").alias("record_id")
        path = F.concat(F.lit("/c/"), "o_custkey", F.lit("/state.csv")).alias("path")
        state = lambda n: F.concat(F.lit("cust:"), "o_custkey", F.lit(":"), n).alias("hash")
        out = self._states.select(rid, F.lit("out").alias("role"), path, state(F.col("n")))
        before = self._states.filter("n > 1").select(rid, F.lit("in").alias("role"), path, state(F.col("n") - 1))
        # Keys are made distinct before they become text.
        lines, rid = self.base("lineitem"), F.concat(F.lit("w"), "l_orderkey").alias("record_id")
        parts = lines.select("l_orderkey", "l_partkey").distinct().select(
            rid, F.lit("in").alias("role"), F.concat(F.lit("/p/"), "l_partkey", F.lit(".csv")).alias("path"), F.concat(F.lit("part:"), "l_partkey").alias("hash"))
        supps = lines.select("l_orderkey", "l_suppkey").distinct().select(
            rid, F.lit("out").alias("role"), F.concat(F.lit("/s/"), "l_suppkey").alias("path"), F.concat(F.lit("supp:"), "l_suppkey").alias("hash"))
        # Each record lists a file once; a line table may repeat a part or supplier within an order.
        return out.unionByName(before).unionByName(parts.unionByName(supps))

    @cached_property
    def signature(self) -> DataFrame:
        """One or two signatures per record; null ``keyid`` where no configured key verifies it."""
        o = self.base("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        c = self.base("customer").select("c_custkey", "c_nationkey")
        j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        first = F.concat(F.lit("n"), "c_nationkey")
        second = F.concat(F.lit("n"), (F.col("c_nationkey") + 7) % 25)
        sigs = F.array(
            F.struct(F.lit(0).cast("bigint").alias("pos"), first.alias("declared"),
                     F.when(F.col("o_orderstatus") != "P", first).alias("keyid")),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
                   F.struct(F.lit(1).cast("bigint").alias("pos"), second.alias("declared"), second.alias("keyid"))),
        )
        return j.select(F.concat(F.lit("w"), "o_orderkey").alias("record_id"),
                        F.explode(F.array_compact(sigs)).alias("s")).select("record_id", "s.*")

    @cached_property
    def trust_key(self) -> DataFrame:
        """Keys by tier; one region is trusted by nobody."""
        n, r = self.base("nation"), self.base("region")
        return (n.join(r, n["n_regionkey"] == r["r_regionkey"]).filter("r_name <> 'AFRICA'")
                .select(F.concat(F.lit("n"), "n_nationkey").alias("keyid"), F.lower("r_name").alias("tier"),
                        F.col("n_name").alias("name")))

    # -- claims ---------------------------------------------------------------------------------------

    @cached_property
    def _events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.base("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"))

    @cached_property
    def claim(self) -> DataFrame:
        """One claim per event, chained per user; the user's first event is the seed of the scope."""
        at = F.struct("ts", "event_id")
        sizes = key_sizes(self._events, ["user_id"])
        chained = scan(self._events, ["user_id"], ["ts", "event_id"],
                       [Scan("first", "min", at), Scan("before", "last", F.struct("event_id"), False)], sizes=sizes)
        own = scan(chained, ["user_id", "event_type", "k"], ["ts", "event_id"],
                   [Scan("mine", "last", F.struct("event_id"), False)], sizes=sizes)
        cid = lambda c: F.concat(F.lit("e"), c)
        level = F.concat(F.lit("L"), F.least(F.floor(F.col("value") / 10), F.lit(2)))
        return own.select(
            cid(F.col("event_id")).alias("claim_id"),
            F.col("event_id").alias("seq"),
            F.concat(F.lit("part:"), "k").alias("subject"),
            F.col("event_type").alias("predicate"),
            F.concat(F.lit("n"), F.col("user_id") % 25).alias("keyid"),
            F.col("ts").alias("at"),
            cid(F.col("first.event_id")).alias("scope"),
            cid(F.col("before.event_id")).alias("prev"),
            F.col("before").isNull().alias("genesis"),
            level.alias("level"),
            F.col("value"),
            cid(F.col("mine.event_id")).alias("replaces"),
            F.concat(F.lit("u"), "user_id").alias("person"),
            F.when(F.col("event_type") == "purchase", F.array(F.lit("own"), F.lit("partner")))
            .when(F.col("event_type").isin("error", "signup"), F.array(F.lit("partner")))
            .otherwise(F.array(F.lit("own"))).alias("registries"),
        )

    @cached_property
    def turn(self) -> DataFrame:
        """Conversation turns as a chain; a system turn is a claim the reader does not hold."""
        key = lambda n: F.concat(F.lit("c"), "conv_id", F.lit(":"), n)
        return self.base("conversations").select(
            key(F.col("turn")).alias("claim_id"),
            key(F.lit(0)).alias("scope"),
            F.when(F.col("turn") > 0, key(F.col("turn") - 1)).alias("prev"),
            (F.col("turn") == 0).alias("genesis"),
            F.col("role").alias("keyid"),
            F.col("turn").cast("bigint").alias("seq"),
            F.col("text"),
        )

    @cached_property
    def label_claim(self) -> DataFrame:
        """Labels as claims with two fields about a document."""
        return self.base("labels").select(
            F.concat(F.lit("l"), "doc_id").alias("claim_id"), F.concat(F.lit("doc:"), "doc_id").alias("subject"),
            F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"))

    # -- traces -----------------------------------------------------------------------------------------

    @cached_property
    def trace_event(self) -> DataFrame:
        """Events as lines of a session's log: reads, writes, renames, removals, execs and task markers."""
        e = self._events
        path = F.concat(F.lit("/proj/"), "k", F.lit(".csv"))
        kept = F.concat(F.lit("/proj/"), "k", F.lit(".old.csv"))
        sha = F.sha2(F.concat(F.col("k").cast("string"), F.lit(":"), F.floor(F.col("value") / 8)), 256)

        def line(n, op, mode, p, extra):
            return F.struct(F.lit(n).alias("n"), F.lit(op).alias("op"), F.lit(mode).alias("mode") if isinstance(mode, str)
                            else mode.alias("mode"), p.alias("path"), extra.alias("extra"))

        none = F.lit("")
        rows = (
            F.when(F.col("event_type") == "view", F.array(
                line(0, "open", "r", path, F.concat(F.lit("sha256="), sha))))
            .when(F.col("event_type") == "purchase", F.array(
                line(0, "open", "w", path, F.lit("trunc=1")),
                line(1, "closew", "-", path, F.concat(F.lit("sha256="), sha))))
            .when(F.col("event_type") == "click", F.array(
                F.when(F.col("value") < 5, line(0, "connect", "-", F.concat(F.lit("inet:10.0.0."), "k", F.lit(":443")),
                                                F.lit("class=remote;rc=0")))
                .otherwise(line(0, "exec", "q", F.lit("/proj"), F.concat(F.lit("/bin/tool"), F.col("k"), F.lit(" -i "),
                                                                         path)))))
            .when(F.col("event_type") == "signup", F.array(
                F.when(F.col("value") >= 12, line(0, "rename", "-", kept, path))
                .otherwise(line(0, "unlink", "-", path, none))))
            .otherwise(F.array(line(0, "TASK", F.when(F.col("value") < 20, "ok").otherwise("err"),
                                    F.concat(F.lit("t"), "event_id"), F.concat(F.lit("expr "), "k"))))
        )
        return e.select("user_id", "event_id", "ts", "k", "value", F.explode(rows).alias("r")).select(
            F.concat(F.lit("s"), "user_id").alias("session"),
            (F.col("event_id") * 2 + F.col("r.n")).alias("ord"),
            (F.unix_micros("ts") * 1000 + F.col("r.n")).alias("ts_ns"),
            F.when(F.col("r.op") == "TASK", 1).otherwise(F.col("k") + 10).alias("pid"),
            F.lit(1).cast("bigint").alias("ppid"),
            "r.op", "r.mode", "r.path",
            F.lit(0).cast("bigint").alias("size"),
            (F.unix_micros("ts") * 1000).alias("mtime_ns"),
            "r.extra",
        )

    @cached_property
    def manifest(self) -> DataFrame:
        """Documents as files: path and content hash."""
        return self.base("documents").select(
            F.concat(F.lit("/d/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id").alias("path"),
            F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("size"), F.col("source"), F.col("lang"),
            F.col("doc_id").alias("ino"))
