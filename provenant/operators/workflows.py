"""Workflows proposed from recorded executions, drafts of publications, reference runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions.paths import base, words
from provenant.operators import graph
from provenant.operators.ordered import numbered
from provenant.operators.records import lineage, lineage_records


def executions(work: DataFrame, work_file: DataFrame) -> DataFrame:
    """What each record ran: directory, words, command file (the first word that is an input), step name."""
    folder = F.nullif(F.regexp_extract("cmd", r"^cd\s+(\S+)\s*&&", 1), F.lit(""))
    line = F.regexp_replace("cmd", r"^cd\s+\S+\s*&&\s*", "")
    w = work.select("record_id", folder.alias("folder"), words(line).alias("words"))
    name = F.coalesce(F.nullif(base("folder"), F.lit("")), F.get("words", 0))
    slots = work_file.filter("role = 'in'").select("record_id", "path")
    named = w.select("record_id", "folder", F.posexplode("words").alias("pos", "word"))
    full = F.when(F.col("word").startswith("/"), F.col("word")).otherwise(F.concat("folder", F.lit("/"), "word"))
    first = named.withColumn("path", full).join(slots, ["record_id", "path"], "left_semi").groupBy("record_id").agg(F.min_by("word", "pos").alias("command_file"))
    return w.join(first, "record_id", "left").select("record_id", "folder", "words", "command_file", name.alias("step"))


def behind_endpoints(work_file: DataFrame, hashes: DataFrame, trusted: DataFrame) -> DataFrame:
    """Distinct verified records behind the endpoints."""
    return lineage_records(work_file, hashes).join(trusted.select("record_id"), "record_id", "left_semi")


def wiring(work_file: DataFrame, records: DataFrame) -> DataFrame:
    """Which record's output is which record's input, among the records."""
    own = work_file.join(records.select("record_id"), "record_id", "left_semi")
    out = own.filter("role = 'out'").select("hash", F.col("record_id").alias("maker"), F.col("path").alias("made_as"))
    return own.filter("role = 'in'").join(out, "hash").filter("maker <> record_id").select("maker", "record_id", "hash", "path")


def parameters(executed: DataFrame) -> DataFrame:
    """Words of the command line that differ between runs of one step, with how many values; a step whose runs
    have different numbers of words conflicts and has none."""
    shape = executed.groupBy("step").agg(F.min(F.size("words")).alias("lo"), F.max(F.size("words")).alias("hi"))
    fine = executed.join(shape.filter("lo = hi"), "step")
    each = fine.select("step", F.posexplode("words").alias("pos", "word")).groupBy("step", "pos").agg(F.count_distinct("word").alias("values"), F.min("word").alias("example"))
    return each.filter("values > 1")


def conflicts(executed: DataFrame) -> DataFrame:
    return executed.groupBy("step").agg(F.min(F.size("words")).alias("lo"), F.max(F.size("words")).alias("hi")).filter("lo <> hi")


def candidates(files: DataFrame, params: DataFrame) -> DataFrame:
    """Numbered candidates per step: files that are no command files, then parameters."""
    rows = files.select("step", F.lit(0).alias("kind"), F.col("path").alias("name")).unionByName(
        params.select("step", F.lit(1).alias("kind"), F.concat(F.lit("word "), F.col("pos").cast("string")).alias("name"))).distinct()
    return numbered(rows, ["step"], ["kind", "name"], "number")


def run_groups(work_file: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Runs: the connected lineage of each endpoint ``(endpoint, record_id, depth)``."""
    return lineage(work_file, endpoints).withColumnRenamed("hash", "endpoint")


def reference_runs(package_claims: DataFrame, work: DataFrame) -> DataFrame:
    """step → record of an installed workflow, where the record is held."""
    return package_claims.join(work.select("record_id"), "record_id", "left_semi").select("workflow", "step", "record_id")


def draft(inputs: DataFrame, outputs: DataFrame, reached: DataFrame) -> DataFrame:
    """Candidate files of a publication per step with a preselection and a note.

    ``inputs`` has (step, path, sha, class, status), ``reached`` files read through variables.
    """
    note = (F.when(F.col("status") == "changed-outside", "changed by hand before it was read").when(F.col("class") == "outside", "outside the project")
            .when(F.col("status") == "unhashed-large", "not hashed"))
    i = inputs.select("step", F.lit("in").alias("role"), "path", "sha", (F.col("class") == "project").alias("selected"), note.alias("note"))
    o = outputs.select("step", F.lit("out").alias("role"), "path", "sha", F.lit(True).alias("selected"), F.lit(None).cast("string").alias("note"))
    v = reached.join(inputs.select("step", "path", "sha"), ["step", "path", "sha"], "left_anti").select(
        "step", F.lit("in").alias("role"), "path", "sha", F.lit(True).alias("selected"), F.lit("read by an earlier step whose object it uses").alias("note"))
    return i.unionByName(o).unionByName(v)


def draft_command(steps: DataFrame) -> DataFrame:
    """The command of a draft by precedence: the call, the script, the code, the expression."""
    script = F.when(F.col("script").isNotNull(), F.concat(F.lit("Rscript "), "script"))
    return steps.select("step", F.coalesce("call", script, F.nullif("code", F.lit("")), "expr").alias("command"))


def components(edges: DataFrame) -> DataFrame:
    """Levels of a workflow's steps from their wiring."""
    up = edges.select(F.col("maker").alias("src"), F.col("record_id").alias("dst")).distinct()
    nodes = up.select(F.col("src").alias("id")).unionByName(up.select(F.col("dst").alias("id")))
    return graph.levels(nodes, up)
