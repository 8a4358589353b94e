"""Named questions over the claim view, the quads and the file table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.terms import hash_sum
from provenant.operators import graph, reach
from provenant.operators.records import lineage


def pattern(quads: DataFrame, p: str, s: str, o: str, g: str | None = None) -> DataFrame:
    """The quads of one predicate as columns named after the variables of a pattern; join them by name."""
    cols = [F.col("s").alias(s), F.col("o").alias(o)] + ([F.col("g").alias(g)] if g else [])
    return quads.filter(F.col("p") == p).select(*cols)


def about_node(quads: DataFrame, node: str | Column) -> DataFrame:
    """Everything said about one node."""
    return quads.filter(F.col("s") == node).select("p", "o")


def compares(value: Column, kind: str, test) -> Column:
    """A comparison on a typed value: what does not read as the type is false, it does not fail."""
    return F.coalesce(test(F.try_to_number(value, F.lit("999999999999999999.999999")) if kind == "decimal" else value.try_cast(kind)),
                      F.lit(False))


def flagged(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """EXISTS as a value: whether ``keys`` has a row with the same ``on``."""
    return df.join(keys.select(*on).distinct().withColumn("__f", F.lit(True)), on, "left").withColumn(
        name, F.col("__f").isNotNull()).drop("__f")


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """NOT EXISTS: null keys are kept, as they match nothing."""
    return df.join(keys.select(*on), on, "left_anti")


def inline(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """VALUES: a few rows of parameters to join with."""
    return spark.createDataFrame(rows, names)


def any_row(df: DataFrame) -> bool:
    """ASK."""
    return not df.isEmpty()


def limited(df: DataFrame, limit: int = 1000) -> tuple[DataFrame, bool]:
    """At most ``limit`` rows and whether the answer was cut; one more row is read to know."""
    if not 0 < limit <= 10_000:
        raise ValueError("between 1 and 10000 rows")
    return df.limit(limit), df.limit(limit + 1).count() > limit


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """A property path of one step or more: distinct ``(src, dst)`` from each start."""
    found = graph.walk(starts.select(F.col("src").alias("root"), F.col("src").alias("node")), edges)
    return found.filter("depth > 0").select(F.col("root").alias("src"), F.col("node").alias("dst"))


def closure_totals(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(src, reached, ends)``: how many nodes a property path of one step or more reaches from each start, and how many of them lead nowhere."""
    index = reach.build(starts.select(F.col("src").alias("id")), edges)
    leading = edges.select(F.col("src").alias("id")).distinct().withColumn("leading", F.lit(True))
    values = index.places.select("id", "round").join(leading, "id", "left").select("id", "round", F.lit(1).cast("bigint").alias("reached"), F.col("leading").isNull().cast("bigint").alias("ends"))
    found = reach.totals(index, values.drop("round"), ["reached", "ends"]).join(values.select("id", "round", F.col("ends").alias("own")), "id")
    # a start counts itself only if it lies on a cycle
    own = F.when(F.col("round"), 0).otherwise(1)
    return starts.select("src").distinct().join(found.select(F.col("id").alias("src"), (F.col("reached") - own).alias("reached"), (F.col("ends") - F.col("own")).alias("ends")), "src")


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The rows with the largest ``at`` per key; ties all come back. A grouped maximum joined back."""
    top = df.groupBy(*keys).agg(F.max(at).alias("__top"))
    return df.join(top, keys).filter(F.col(at) == F.col("__top")).drop("__top")


def users_with_signer(work_file: DataFrame, hashes: DataFrame, attribution: DataFrame) -> DataFrame:
    """Steps that used a file, with the signer where there is one."""
    used = work_file.filter("role = 'in'").join(hashes, "hash", "left_semi").select("hash", "record_id").distinct()
    return used.join(attribution.select("record_id", "keyid"), "record_id", "left").select("hash", "record_id", "keyid")


def labelled(view: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Claims of some predicates with a label for each."""
    name = F.lit(None).cast("string")
    for predicate, label in labels.items():
        name = F.when(F.col("predicate") == predicate, label).otherwise(name)
    return view.filter(F.col("predicate").isin(*labels)).withColumn("label", name)


def newest(view: DataFrame, keys: list[str], at: str, what: list[str], ident: str = "claim_id") -> DataFrame:
    """The newest claim per key; the smallest id on a tie. Reduced before the shuffle, no sort of a group."""
    last = view.groupBy(*keys).agg(F.max(at).alias("__last"))
    tied = view.join(last, keys).filter(F.col(at) == F.col("__last"))
    return tied.groupBy(*keys).agg(F.min_by(F.struct(*what), ident).alias("r")).select(*keys, "r.*")


def in_window(view: DataFrame, keyid: Column | str, start, end) -> DataFrame:
    """Claims of one signer in a half-open interval of signed time."""
    return view.filter((F.col("keyid") == keyid) & (F.col("at") >= F.lit(start)) & (F.col("at") < F.lit(end)))


def files_of_several(work_file: DataFrame, attribution: DataFrame) -> DataFrame:
    """Files that two different steps with different signers produced: distinct (hash, path).

    Two (step, signer) pairs that differ in both exist exactly when the pairs share neither one step nor one
    signer, that is when both the least and largest step and the least and largest signer differ. So four
    running values per file replace the join of its producers with themselves.
    """
    made = work_file.filter("role = 'out'").select("hash", "path", "record_id").join(attribution.select("record_id", "keyid"), "record_id")
    two = lambda c: F.min(c) != F.max(c)
    return made.groupBy("hash").agg(two("record_id").alias("steps"), two("keyid").alias("signers"), F.min("path").alias("path")).filter(
        "steps AND signers").select("hash", "path")


def runs_of_script(work_file: DataFrame, path_form: str) -> DataFrame:
    """Steps that read a file whose path fits."""
    return work_file.filter((F.col("role") == "in") & F.col("path").rlike(path_form)).select("record_id", "path", "hash").distinct()


def all_sources(work_file: DataFrame, hashes: DataFrame) -> DataFrame:
    """Everything each file was derived from, directly or not: ``(hash, source, path)``."""
    # Inputs nobody produced end a walk; they are added after it, where the walk needs no round for them.
    behind = lineage(work_file, hashes).select("hash", "record_id")
    read = work_file.filter("role = 'in'").select("record_id", F.col("hash").alias("source"), "path")
    return behind.join(read, "record_id").groupBy("hash", "source").agg(F.min("path").alias("path"))


def trusted_production(work_file: DataFrame, attribution: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per file whether a trusted key produced it."""
    signed = work_file.filter("role = 'out'").join(attribution.select("record_id"), "record_id", "left_semi").select("hash")
    return flagged(hashes, signed, ["hash"], "trusted")


def current(view: DataFrame, predicate: str) -> DataFrame:
    """Records of a kind in their latest version."""
    return view.filter((F.col("predicate") == predicate) & ~F.col("replaced"))


def history(versions: DataFrame, replaced_by: DataFrame) -> DataFrame:
    """All versions with what each replaces and what replaced it."""
    return versions.join(replaced_by, "claim_id", "left").select("claim_id", "subject", "created", "replaces", "replaced_by")


def approvals(approving: DataFrame, records: DataFrame) -> DataFrame:
    """Approvals of records: who approved which, with the record's own kind."""
    told = approving.select(F.col("claim_id").alias("approval"), F.col("keyid").alias("approver"), "target")
    return told.join(records.select(F.col("claim_id").alias("target"), "predicate", "subject"), "target")


def of_scope_named(view: DataFrame, labels: DataFrame, label: Column | str) -> DataFrame:
    """Claims of the scopes with a name, by position; replaced ones are left out."""
    named = labels.filter(F.col("label") == label).select(F.col("graph").alias("scope"), "label")
    return view.filter(~F.col("replaced")).join(named, "scope")


def obligations_of(person: DataFrame, documents: DataFrame, trained: DataFrame) -> DataFrame:
    """Open and met obligations per person as numbers: everybody owes every document.

    The pairs of all people and all documents are never formed: what a person met is counted, the rest is
    open. ``obligations_for`` lists the documents of one person.
    """
    met = trained.join(documents, "document", "left_semi").select("person", "document").distinct().groupBy("person").agg(
        F.count(F.lit(1)).alias("met"))
    total = documents.select("document").distinct().count()
    return person.select("person").distinct().join(met, "person", "left").select(
        "person", F.coalesce("met", F.lit(0)).alias("met"), (F.lit(total) - F.coalesce("met", F.lit(0))).alias("open"))


def obligations_for(person: str, documents: DataFrame, trained: DataFrame) -> DataFrame:
    """The documents one person owes, with whether they were trained on each."""
    mine = trained.filter(F.col("person") == person)
    return flagged(documents.select("document").distinct(), mine, ["document"], "trained")


def finding(rule: str, violations: DataFrame, subject: str, message: Column) -> DataFrame:
    """The shape all rules answer in; unite rules with ``unionByName``."""
    return violations.select(F.lit(rule).alias("rule"), F.col(subject).alias("subject"), message.alias("message"))


def manifest(records: DataFrame, key: str) -> DataFrame:
    """The pinned inputs of a reproducible run: every id once."""
    return records.select(F.col(key).alias("id")).distinct()


def on_pinned_chains(claims: DataFrame, heads: DataFrame) -> DataFrame:
    """Claims on the chains that end at the pinned heads."""
    back = claims.filter("prev IS NOT NULL").select(F.col("claim_id").alias("src"), F.col("prev").alias("dst"))
    found = graph.walk(heads.select(F.col("claim_id").alias("root"), F.col("claim_id").alias("node")), back, long=True)
    return claims.join(found.select(F.col("node").alias("claim_id")), "claim_id", "left_semi")


def result_hash(answer: DataFrame) -> DataFrame:
    """A hash of an answer as a multiset of rows: the order of rows does not matter, how often one comes does."""
    row = F.sha2(F.to_json(F.struct(*sorted(answer.columns)), {"ignoreNullFields": "false"}), 256)
    return answer.agg(F.count(F.lit(1)).alias("rows"), hash_sum(row).alias("hash"))


def open_messages(messages: DataFrame, lanes: DataFrame, closed: DataFrame) -> DataFrame:
    """Open messages per lane as numbers with the newest; a lane without messages has none."""
    open_ = messages.join(closed.select("message"), "message", "left_anti")
    per = open_.groupBy("topic").agg(F.count(F.lit(1)).alias("open"), F.max_by("message", "at").alias("newest"))
    return lanes.join(per, "topic", "left").select("lane", "topic", F.coalesce("open", F.lit(0)).alias("open"), "newest")


def unseen(messages: DataFrame, seen: DataFrame) -> DataFrame:
    return messages.join(seen.select("message"), "message", "left_anti")


def in_folder(rows: DataFrame, path: str, suffix: str) -> DataFrame:
    """Rows of files under a folder named by the end of its path."""
    return rows.filter(F.regexp_replace(F.col(path), "/[^/]*$", "").endswith(suffix))
