"""Grouped and windowed jobs over orders, line items and documents; comparisons of texts."""

from pyspark.sql import functions as F

from provenant.operators import compare as C
from provenant.operators import studies as S
from provenant.plans.registry import query


def samples(t):
    """Orders as samples: a customer, the day of the order and its price."""
    o = t.base("orders")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("double") - 9000
    return o.select(F.col("o_custkey").alias("subject"), day.alias("time"), F.col("o_totalprice").alias("conc"), F.col("o_orderkey").alias("id"),
                    F.col("o_orderstatus").alias("period"))


SM = """sm AS (SELECT o_custkey AS subject, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE)-9000 AS time, o_totalprice AS conc, o_orderkey AS id, o_orderstatus AS period FROM orders),
st AS (SELECT *, lag(time) OVER w AS pt, lag(conc) OVER w AS pc, row_number() OVER (PARTITION BY subject ORDER BY time DESC, id DESC) AS back, row_number() OVER w AS fwd FROM sm WINDOW w AS (PARTITION BY subject ORDER BY time, id))"""


@query("prepared_samples", """WITH d AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity*l_discount AS VARCHAR) AS DECIMAL(30,18)) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN (d*10)%1=0.5 AND floor(d*10)%2=0 THEN floor(d*10)/10 ELSE round(d,1) END AS DOUBLE) AS dose FROM d""")
def _(t):
    return S.derived_dose(t.base("lineitem"), "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", "dose")


@query("distinct_subjects", "SELECT DISTINCT o_custkey AS subject, o_orderstatus AS period FROM orders")
def _(t):
    return S.subjects(samples(t), ["subject", "period"])


@query("trapezoid_per_subject", f"WITH {SM} SELECT subject, max(conc) AS cmax, arg_min(time,(-conc,time)) AS tmax, round(coalesce(sum((time-pt)*(conc+pc)/2),0),4) AS auc FROM st GROUP BY subject")
def _(t):
    return S.trapezoid(samples(t), ["subject"], "time", "conc", ("id",)).withColumn("auc", F.round("auc", 4))


@query("trapezoid_per_period", f"""WITH {SM}, s2 AS (SELECT *, lag(time) OVER v AS t0, lag(conc) OVER v AS c0 FROM sm WINDOW v AS (PARTITION BY subject, period ORDER BY time, id))
SELECT subject, period, max(conc) AS cmax, round(coalesce(sum((time-t0)*(conc+c0)/2),0),4) AS auc FROM s2 GROUP BY ALL""")
def _(t):
    return S.trapezoid(samples(t), ["subject", "period"], "time", "conc", ("id",)).select("subject", "period", "cmax", F.round("auc", 4).alias("auc"))


@query("log_down_area", f"""WITH {SM} SELECT subject, round(coalesce(sum(CASE WHEN conc<pc AND conc>0 THEN (time-pt)*(pc-conc)/ln(pc/conc) ELSE (time-pt)*(conc+pc)/2 END),0),1) AS auc FROM st GROUP BY subject""")
def _(t):
    return S.trapezoid(samples(t), ["subject"], "time", "conc", ("id",), log_down=True).select("subject", F.round("auc", 1).alias("auc"))


@query("terminal_half_life", f"""WITH {SM}, r AS (SELECT subject, -regr_slope(ln(conc), time) AS l, count(*) AS n FROM st WHERE back<=3 GROUP BY subject)
SELECT subject, CASE WHEN n=3 AND l>0 THEN round(ln(2)/l,4) END AS half_life FROM r""")
def _(t):
    return S.half_life(samples(t), ["subject"], "time", "conc", ("id",)).select("subject", F.round("half_life", 4).alias("half_life"))


@query("extrapolated_start", f"""WITH {SM}, f AS (SELECT subject, max(time) FILTER (fwd=1) AS t1, max(conc) FILTER (fwd=1) AS c1, max(time) FILTER (fwd=2) AS t2, max(conc) FILTER (fwd=2) AS c2 FROM st GROUP BY subject)
SELECT subject, CASE WHEN abs((ln(c1)-ln(c2))/(t2-t1)*t1)<300 THEN round(ln(c1*exp((ln(c1)-ln(c2))/(t2-t1)*t1)),3) END AS ln_start FROM f WHERE t2>t1 AND t1>0""")
def _(t):
    rows = S.with_start(samples(t), ["subject"], "time", "conc", ("id",)).filter("time = 0")
    # beyond e**300 the value itself is out of range: the subject stays, its start is unknown
    return rows.select("subject", F.when(F.abs(F.ln("conc")) < 300, F.round(F.ln("conc"), 3)).alias("ln_start"))


@query("median_clearance", f"""WITH {SM}, r AS (SELECT subject, -regr_slope(ln(conc), time) AS l FROM st WHERE back<=3 GROUP BY subject HAVING count(*)=3),
a AS (SELECT subject, coalesce(sum((time-pt)*(conc+pc)/2),0) AS auc, arg_max(conc,(time,id)) AS cl, sum(conc) AS dose FROM st GROUP BY subject)
SELECT round(median(dose/(auc+cl/l)),9) AS median FROM a JOIN r USING (subject) WHERE l>0""")
def _(t):
    s = samples(t)
    doses = s.groupBy("subject").agg(F.sum("conc").alias("dose"))
    cl = S.clearance(s, doses, ["subject"], "time", "conc", ("id",))
    return S.middle(cl, "clearance").select(F.round("median", 9).alias("median"))


@query("paired_comparison", """WITH p AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (l_returnflag='A') AS a, avg(l_extendedprice) FILTER (l_returnflag='N') AS n FROM lineitem GROUP BY l_suppkey)
SELECT count(*) AS n, round(avg(ln(a)-ln(n)),8) AS mean, round(stddev_samp(ln(a)-ln(n)),8) AS sd FROM p WHERE a IS NOT NULL AND n IS NOT NULL""")
def _(t):
    stats = S.paired_logs(t.base("lineitem"), "l_suppkey", "l_returnflag", "l_extendedprice", ("A", "N"))
    return stats.select("n", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"))


@query("ratio_interval", """WITH RECURSIVE p AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (l_returnflag='A') AS a, avg(l_extendedprice) FILTER (l_returnflag='N') AS n FROM lineitem GROUP BY l_suppkey),
s AS (SELECT count(*) AS n, avg(ln(a)-ln(n)) AS m, stddev_samp(ln(a)-ln(n)) AS sd FROM p WHERE a IS NOT NULL AND n IS NOT NULL),
b AS (SELECT n, n-1.0 AS df, 0.0::DOUBLE AS lo, 700.0::DOUBLE AS hi, 0 AS i FROM s UNION ALL
  SELECT n, df, CASE WHEN c<0.45 THEN x ELSE lo END, CASE WHEN c<0.45 THEN hi ELSE x END, i+1 FROM (SELECT *, x/3000*exp(lgamma((df+1)/2)-lgamma(df/2))/sqrt(df*pi())*
    list_sum(list_transform(range(0,1001), lambda k: CASE WHEN k IN (0,1000) THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END*pow(1+(x*k/1000)*(x*k/1000)/df,-(df+1)/2))) AS c
    FROM (SELECT *, (lo+hi)/2 AS x FROM b WHERE i<60)))
SELECT s.n, round(exp(m),6) AS ratio, round(exp(m-lo*sd/sqrt(s.n)),6) AS low, round(exp(m+lo*sd/sqrt(s.n)),6) AS high FROM s, b WHERE i=60""")
def _(t):
    stats = S.paired_logs(t.base("lineitem"), "l_suppkey", "l_returnflag", "l_extendedprice", ("A", "N"))
    return S.ratio_interval(stats).select("n", *[F.round(c, 6).alias(c) for c in ("ratio", "low", "high")])


@query("simple_regression", "SELECT l_returnflag AS flag, round(regr_slope(l_extendedprice,l_quantity),6) AS slope, round(corr(l_quantity,l_extendedprice),9) AS r, regr_count(l_extendedprice,l_quantity) AS n FROM lineitem GROUP BY 1")
def _(t):
    fit = S.regression(t.base("lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_quantity", "l_extendedprice")
    return S.slope_p(fit).select("flag", F.round("slope", 6).alias("slope"), F.round("r", 9).alias("r"), "n")


@query("exposure_against_target", """SELECT l_linenumber AS dose, min(l_quantity) AS least, max(l_quantity) AS most, min(l_quantity)>=1 AS reached, max(l_quantity)<=49 AS safe FROM lineitem GROUP BY 1""")
def _(t):
    l = t.base("lineitem").select(F.col("l_linenumber").alias("dose"), F.col("l_quantity").alias("value"), "l_returnflag")  # noqa: E741
    parts = [l.filter(F.col("l_returnflag") == f).select("dose", "value") for f in ("A", "N", "R")]
    return S.exposure(parts, 1, 49)


@query("study_file", "SELECT o_custkey AS subject, o_totalprice AS dv FROM orders")
def _(t):
    return S.study_file(samples(t), {"subject": "subject", "conc": "dv"}, ["subject", "dv"])


@query("oldest_groups", "SELECT c_mktsegment AS segment, round(2026-avg(year(o_orderdate)),1) AS age FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    o = t.base("orders").join(t.base("customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("o_custkey") == F.col("c_custkey"))
    return S.ranking(o.select("segment", F.year("o_orderdate").cast("string").alias("year")), "segment", "year", 2026, 5)


@query("oldest_with_sentinel", """WITH y AS (SELECT p_brand AS brand, CASE WHEN p_size<5 THEN 0 ELSE 2000+p_size END AS y FROM part)
SELECT brand, round(2026-avg(y),1) AS age FROM y WHERE y>0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(t):
    p = t.base("part").select(F.col("p_brand").alias("brand"), F.when(F.col("p_size") < 5, "0").otherwise((F.col("p_size") + 2000).cast("string")).alias("year"))
    return S.ranking(p, "brand", "year", 2026, 5)


def pairs(t):
    """Each supplier's report of its line items against itself with the tax added to the price in a few lines."""
    line = F.concat_ws(" ", "l_orderkey", "l_linenumber", F.format_string("%.2f", F.col("l_extendedprice")))
    other = F.concat_ws(" ", "l_orderkey", "l_linenumber", F.format_string("%.2f", F.when(F.col("l_linenumber") == 7, F.col("l_extendedprice") * 1.0005).otherwise(F.col("l_extendedprice"))))
    l = t.base("lineitem")  # noqa: E741
    rows = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("pair"), line.alias("a"), other.alias("b"))
    both = rows.select("pair", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("text")), F.struct(F.lit("b").alias("side"), F.col("b").alias("text")))).alias("f"))
    return both.select("pair", "f.side", "f.text", F.sha2("f.text", 256).alias("sha")).distinct()


@query("compared_files", """SELECT DISTINCT l_orderkey||'-'||l_linenumber||'-'||l_suppkey||'-'||l_partkey||'-'||CAST(round(l_extendedprice*100) AS BIGINT) AS pair, CASE WHEN l_linenumber=7 THEN 'within' ELSE 'same' END AS verdict FROM lineitem""")
def _(t):
    return C.compare_files(pairs(t), 1e-3).select("pair", "verdict")


@query("two_sided_results", """WITH a AS (SELECT url AS name, sha256(html) AS h FROM pages WHERE url LIKE 'http://%' OR url LIKE 'https://m.%'), b AS (SELECT url AS name, sha256(html) AS h FROM pages WHERE url LIKE 'https://%')
SELECT name, CASE WHEN a.h IS NULL THEN 'missing-left' WHEN b.h IS NULL THEN 'missing-right' WHEN a.h=b.h THEN 'equal' ELSE 'different' END AS state FROM a FULL JOIN b USING (name)""")
def _(t):
    p = t.base("pages").select(F.col("url").alias("name"), F.sha2("html", 256).alias("h"))
    return C.two_sided(p.filter("name LIKE 'http://%' OR name LIKE 'https://m.%'"), p.filter("name LIKE 'https://%'"), "name", "h")


@query("two_sided_totals", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN url LIKE 'http://%' THEN 'missing-right' WHEN url LIKE 'https://m.%' THEN 'equal' ELSE 'missing-left' END AS state FROM pages) GROUP BY 1""")
def _(t):
    p = t.base("pages").select(F.col("page_id").alias("name"), F.sha2("html", 256).alias("h"), "url")
    return C.totals(C.two_sided(p.filter("url LIKE 'http://%' OR url LIKE 'https://m.%'"), p.filter("url LIKE 'https://%'"), "name", "h"))


@query("anonymised_text", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text,'[A-Za-z0-9._-]+@[A-Za-z0-9.-]+','<mail>','g'),'[0-9]{3,}','<number>','g')) AS clean,
 regexp_replace(regexp_replace(text,'[A-Za-z0-9._-]+@[A-Za-z0-9.-]+','<mail>','g'),'[0-9]{3,}','<number>','g')<>text AS changed FROM documents""")
def _(t):
    rules = [(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "<mail>"), (r"[0-9]{3,}", "<number>")]
    return C.anonymised(t.base("documents"), "text", rules).select("doc_id", F.sha2("clean", 256).alias("clean"), "changed")
