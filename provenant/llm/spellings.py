"""Spelling variants: words one letter apart, found by a dictionary of pairs of trie nodes.

1. Every prefix of a word is a node of the forward trie, every suffix one of the reversed trie. A node is known by a digest chained along
   its path, so a word of any length takes work in proportion to it, and different nodes get numbers.
2. A word cut before place i is the pair (node of what is before, node of what follows); no other word has that pair. A word
   with place i skipped is the pair (node of what is before, node of what follows the place).
3. Two words are a replacement apart if they share a skipped pair, in one place only; a word is a deletion apart from another if its
   skipped pair is the other's cut. In a run of equal letters only the last is skipped for this, so that each link is found once.
4. Words are numbered by falling count, then by code points, so the best near word is the one with the smallest number. A pair's words
   differ in one letter, hence a group has at most one word per letter of the alphabet.
5. Each word's form is its best near word if that is ``RATIO`` times as frequent; roots are found by doubling.

Defined results: null texts, null words and empty words give nothing; words that repeat are one with the sum of their counts; null doc_ids count as an empty
string in the hash of ``damaged``; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import rows, stored

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
# Nodes on more than one of so many rows are numbered by a join with a broadcast table; there are at most so many of them.
HOT_NODES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``run``: maximal runs of the letters a-z, A-Z and U+00C0 to U+00FF, with A-Z in lower case."""
    text = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    return docs.where("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))


def damaged(run: Column, doc_id: Column, every: int = 97) -> Column:
    """``run``, less one code point where ``every`` divides the hash of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(found: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word``, ``n`` of ``found(word)``: words of enough code points that occur often enough."""
    return found.where(F.length("word") >= min_length).groupBy("word").agg(F.count("word").alias("n")).where(F.col("n") >= min_count)


def _nodes(batches):
    """Cut and skipped pairs of each word as digests of their nodes; an empty side is null, the root."""
    for batch in batches:
        who, kind, left, right = [], [], [], []
        for number, word in rows([batch], "number", "word"):
            letters = [c.encode("utf-8", "surrogatepass") for c in word]
            n, before, after = len(letters), _chain(letters), _chain(letters[::-1])[::-1]
            last = [i + 1 == n or letters[i] != letters[i + 1] for i in range(n)]
            who += [number] * (2 * n + 1)
            kind += [0] * (n + 1) + [1 + x for x in last]
            left += before + before[:n]
            right += after + after[1:]
            if len(who) >= 100_000:
                yield _pairs(who, kind, left, right)
                who, kind, left, right = [], [], [], []
        yield _pairs(who, kind, left, right)


def _pairs(who, kind, left, right) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(kind, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["number", "kind", "left", "right"])


def _chain(letters: list[bytes]) -> list[bytes | None]:
    out, here = [None], b""
    for c in letters:
        here = hashlib.blake2b(here + c, digest_size=16).digest()
        out.append(here)
    return out


def _numbered(pairs: DataFrame, total: int, side: str) -> DataFrame:
    """``pairs`` with the nodes of one side as numbers; the root is 0."""
    nodes = stored(pairs.where(F.col(side).isNotNull()).groupBy(side).agg(F.count(side).alias("times")).withColumn("node", F.monotonically_increasing_id() + 1))
    # sums of all times are at most total, so fewer than HOT_NODES nodes pass
    hot = F.col("times") * HOT_NODES > total
    frequent = F.broadcast(nodes.where(hot).select(side, F.col("node").alias("frequent")))
    first = pairs.join(frequent, side, "left").withColumn("rest", F.when(F.col("frequent").isNull(), F.col(side)))
    rest = nodes.where(~hot).select(F.col(side).alias("rest"), "node")
    known, open_ = first.where("rest IS NULL"), first.where("rest IS NOT NULL")
    joined = known.withColumn("node", F.coalesce("frequent", F.lit(0).cast("long"))).unionByName(open_.join(rest, "rest"))
    return joined.drop(side, "frequent", "rest").withColumnRenamed("node", side)


def links(words: DataFrame) -> DataFrame:
    """``number``, ``n_near``, ``best`` of ``words(number, word)``: how many words are one letter apart and the smallest number among them."""
    pairs = stored(words.select("number", "word").mapInArrow(_nodes, "number long, kind int, left binary, right binary"))
    total = pairs.count()
    pairs = _numbered(_numbered(pairs, total, "left"), total, "right")
    skipped = lambda least: F.array_sort(F.collect_list(F.when(F.col("kind") >= least, F.col("number"))))
    groups = (
        pairs.groupBy("left", "right")
        .agg(skipped(1).alias("some"), skipped(2).alias("last"), F.max(F.when(F.col("kind") == 0, F.col("number"))).alias("whole"))
        .where((F.size("some") > 1) | (F.size("some") > 0) & F.col("whole").isNotNull())
    )
    linked = F.col("whole").isNotNull() & F.array_contains("last", F.col("number"))
    other = F.when(F.col("number") == F.get("some", F.lit(0)), F.get("some", F.lit(1))).otherwise(F.get("some", F.lit(0)))
    of_skipped = groups.select("*", F.explode("some").alias("number")).select(
        "number", (F.size("some") - 1 + linked.cast("int")).alias("n_near"), F.least(other, F.when(linked, F.col("whole"))).alias("best"))
    of_whole = groups.where("whole IS NOT NULL AND size(last) > 0").select(F.col("whole").alias("number"), F.size("last").alias("n_near"), F.get("last", F.lit(0)).alias("best"))
    return of_skipped.unionByName(of_whole).where("n_near > 0").groupBy("number").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``number``, ``root``: the end of the way along ``forms(number, form)``, in rounds that double the way."""
    ways = stored(forms.select("number", F.col("form").alias("root")))
    while True:
        next_ = ways.select(F.col("number").alias("root"), F.col("root").alias("further"))
        ways = stored(ways.join(next_, "root", "left").select("number", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            return ways.select("number", "root")


def forms(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for each word of ``vocabulary(word, n)``."""
    once = vocabulary.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(once.orderBy(F.desc("n"), "word").withColumn("number", F.monotonically_increasing_id()))
    near = stored(links(words))
    best = words.select(F.col("number").alias("best"), F.col("n").alias("best_n"))
    chosen = stored(words.join(near, "number").join(best, "best").where(F.col("best_n") >= ratio * F.col("n")).select("number", F.col("best").alias("form")))
    name = lambda c: words.select(F.col("number").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n"))
    found = chosen.join(_roots(chosen), "number").join(name("form"), "form").join(name("root"), "root").select("number", "form_word", "root_word", "form_n")
    return words.join(near.drop("best"), "number", "left").join(found, "number", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


# The hash is written out bit by bit, as DuckDB has none of this kind.
SQL = f"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS b))),
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY doc_id, run),
b AS (SELECT doc_id, run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, v: xor(c >> 8, t.t[1 + (xor(c, v) & 255)])), 4294967295) AS h FROM b, t),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
s AS (SELECT word, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word AS a, b.word AS b FROM s AS a JOIN s AS b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT s.word, w.word FROM s JOIN w ON w.word = s.l || s.r UNION SELECT w.word, s.word FROM s JOIN w ON w.word = s.l || s.r),
f AS (SELECT a.word, a.n, count(o.word) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS best, first(o.n ORDER BY o.n DESC, o.word) AS best_n
  FROM w AS a LEFT JOIN near ON near.a = a.word LEFT JOIN w AS o ON o.word = near.b GROUP BY a.word, a.n),
g AS (SELECT word, n, n_near, CASE WHEN best_n >= {RATIO} * n THEN best END AS form, CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n FROM f),
c AS (SELECT word, word AS root, 0 AS step FROM g UNION ALL SELECT c.word, g.form, step + 1 FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL),
e AS (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM g JOIN e USING (word)"""
