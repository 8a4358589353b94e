"""The readings of the tables themselves."""

from pyspark.sql import functions as F

from provenant.plans.registry import query


@query("reading_work", "SELECT record_id, kind, cmd, environment, declared FROM work")
def _(t):
    return t.work.select("record_id", "kind", "cmd", "environment", "declared")


@query("reading_work_file", "SELECT * FROM work_file")
def _(t):
    return t.work_file


@query("reading_signature", "SELECT * FROM signature")
def _(t):
    return t.signature


@query("reading_claim", """SELECT claim_id, subject, predicate, keyid, epoch_us(claim.at) AS at_us, scope, prev, genesis,
       level, replaces, person, array_to_string(registries, ',') AS registries FROM claim""")
def _(t):
    return t.claim.select("claim_id", "subject", "predicate", "keyid", F.unix_micros("at").alias("at_us"), "scope", "prev",
                          "genesis", "level", "replaces", "person", F.array_join("registries", ",").alias("registries"))


@query("reading_trace", "SELECT session, ord, ts_ns, pid, ppid, op, mode, path, mtime_ns, extra FROM trace_event")
def _(t):
    return t.trace_event.drop("size")


@query("reading_manifest", "SELECT * FROM manifest")
def _(t):
    return t.manifest
