"""URL filter by a character language-model ratio.

Two smoothed variable-order Markov models (Witten-Bell interpolation of the contexts of 5, 4, ... 0 characters) are
counted over all URLs that a host/path rule accepts and all that one rejects. A URL that no rule fits is judged by the
length-normalised log-likelihood difference of the two models, against a threshold calibrated on the ruled URLs that
were kept out of the counts.

Everything is DataFrame operations. Counts are taken per distinct n-gram, with map-side partial sums, so a host that
holds a third of the rows costs no more than any other; scores are computed once per distinct n-gram. A bounded number
of scores, those met oftenest, is broadcast; the others are joined by shuffle, as is all else that grows with the URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with the rule's; longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
CONTEXT = 5
#: Probability that the empty context's escape spreads over: one of 256 symbols.
SYMBOLS = 256
#: Width of a calibration bin, in millionths of a nat per character.
BIN = 10_000
#: Fewer n-grams than this are broadcast with their scores: those that are met more than one in so many times.
OFTEN = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; '' for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: Column) -> Column:
    """One (CONTEXT + 1)-gram for each character and for the end; \\x02 stands before the text, \\x03 after it."""
    padded = F.concat(F.lit("\x02" * CONTEXT), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(CONTEXT + 1)))


def gram_scores(grams: DataFrame) -> DataFrame:
    """grams: (gram, na, nr, n), distinct, with counts in both classes and in all -> (gram, llr, n), llr in millionths of a nat.

    One level for each order: the distinct suffixes of a length with their counts, the sums of their context (the rows
    that share it are its next characters) and the probability of their own suffix from the level below. No key of any
    level has more rows than the alphabet has characters.
    """
    longest = Scratch(grams.sparkSession, "grams").put(grams)  # read once for each level
    levels = {k: longest.groupBy(F.right(F.col("gram"), F.lit(k)).alias("s")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr")) for k in range(1, CONTEXT + 1)}
    levels[CONTEXT + 1] = longest.select(F.col("gram").alias("s"), "na", "nr", "n")

    def step(p: Column, n: Column, c: Column, t: Column) -> Column:
        return F.when(c > 0, (n + t * p) / (c + t)).otherwise(p)

    below = None
    for k in range(1, CONTEXT + 2):
        w = Window.partitionBy(F.left(F.col("s"), F.lit(k - 1)))
        sums = {"ca": F.sum("na").over(w), "cr": F.sum("nr").over(w), "ta": F.count_if(F.col("na") > 0).over(w), "tr": F.count_if(F.col("nr") > 0).over(w)}
        rows = levels[k].withColumns({name: c.cast("double") for name, c in sums.items()})
        if below is None:
            rows = rows.withColumns({"pa": F.lit(1.0 / SYMBOLS), "pr": F.lit(1.0 / SYMBOLS)})
        else:
            # the hint: a level's rows grow with the URLs, so they are never broadcast, however small their files are
            rows = rows.withColumn("_suffix", F.right(F.col("s"), F.lit(k - 1))).join(below.withColumnRenamed("s", "_suffix").hint("merge"), "_suffix")
        below = rows.select("s", *(["n"] if k > CONTEXT else []), step(F.col("pa"), F.col("na"), F.col("ca"), F.col("ta")).alias("pa"), step(F.col("pr"), F.col("nr"), F.col("cr"), F.col("tr")).alias("pr"))
    return below.select(F.col("s").alias("gram"), F.floor((F.log("pa") - F.log("pr")) * 1e6 + 0.5).alias("llr"), "n")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score_micro), one row per row of pages.

    Null URLs and URLs without :// have empty host and path; they fit no rule and are judged by the models like any
    other text (null as ''). With no accepted or no rejected URLs the threshold is 0. score_micro is the mean
    log-likelihood difference per character (millionths of a nat); equal to the threshold counts as allow. Repeated
    rows stay; other columns of pages are not read.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    base = base.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_text", F.coalesce("_url", F.lit("")))
    texts = base.groupBy("_text").agg(F.first("_rule.verdict").alias("cls"))
    texts = texts.withColumn("held", F.left(F.md5("_text"), F.lit(1)) < "5")
    # distinct URLs are few bytes but many grams, so they are dealt out over more files than their bytes would fill
    spark, size = pages.sparkSession, int(base.agg(F.sum(F.octet_length("_text"))).first()[0] or 0)
    files = max(1, min(-(-size // (64 << 10)), 4 * spark.sparkContext.defaultParallelism), -(-size // (64 << 20)))
    scratch = Scratch(spark, "urls")
    texts = scratch.put(texts.repartition(files, "_text").withColumn("_uid", F.monotonically_increasing_id()))
    exploded = texts.select("_uid", "cls", "held", F.explode(_grams(F.col("_text"))).alias("gram"))
    counted = lambda v: F.count_if((F.col("cls") == v) & ~F.col("held"))
    scores = scratch.put(gram_scores(exploded.groupBy("gram").agg(counted("allow").alias("na"), counted("block").alias("nr"), F.count("*").alias("n"))))
    # a URL's grams that are met often stay in its task, the others are rows of few bytes; their files are small, so what is shuffled has a hint
    often = F.broadcast(scores.where(F.col("n") * OFTEN > (scores.agg(F.sum("n")).first()[0] or 0)).select("gram", "llr"))
    grams = exploded.select("_uid", "gram")
    met = grams.join(often, "gram").unionByName(grams.join(often, "gram", "left_anti").join(scores.select("gram", "llr").hint("merge"), "gram"))
    scored = met.groupBy("_uid").agg(F.floor(F.sum("llr") / F.count("*")).alias("score_micro"))
    scored = Scratch(spark, "scored").put(texts.join(scored.hint("merge"), "_uid").select("_text", "score_micro", "cls", "held"))  # read for the threshold and for the verdicts
    scratch.drop(texts, scores)
    limit = threshold(scored.where("held and cls is not null"))
    judged = scored.select("_text", "score_micro").hint("merge")
    return base.join(judged, "_text").crossJoin(F.broadcast(limit)).select(  # one row
        F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("score_micro") >= F.col("_limit"), "allow").otherwise("block")).alias("verdict"), "score_micro",
    )


def threshold(held: DataFrame) -> DataFrame:
    """One row (_limit): the bin edge with the least balanced error over (cls, score_micro); then the one nearest 0."""
    bins = held.groupBy(F.floor(F.col("score_micro") / BIN).alias("b")).agg(F.count_if(F.col("cls") == "allow").alias("a"), F.count_if(F.col("cls") == "block").alias("r"))
    over = Window.orderBy("b")  # the bins' number is bounded by the range of a log-probability, not by the rows
    every = Window.partitionBy()
    below = bins.select("b", F.coalesce(F.sum("a").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("miss"), F.sum("r").over(over.rowsBetween(0, Window.unboundedFollowing)).alias("slip"), F.sum("a").over(every).alias("na"), F.sum("r").over(every).alias("nr"))
    # whole numbers, so that ties are exact: misses x rejected + slips x accepted
    best = below.select("b", (F.col("miss") * F.col("nr") + F.col("slip") * F.col("na")).alias("cost"), "na", "nr")
    return best.agg(F.min(F.when((F.col("na") > 0) & (F.col("nr") > 0), F.struct("cost", F.abs("b").alias("d"), "b"))).alias("m")).select(F.coalesce(F.col("m.b") * BIN, F.lit(0)).alias("_limit"))


def op10_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


OP10_SQL = r"""
with base as (
  select page_id, coalesce(url, '') as txt,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
ruled as (
  select *, case
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from base),
judged as (select *, case rule when 'example.com/de/' then 'block' when 'net/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow' end as cls from ruled),
texts as (select distinct txt, cls from judged),
grams0 as (select txt, cls, substr(repeat(chr(2), 5) || txt || chr(3), i, 6) as gram
  from (select txt, cls, unnest(range(1, length(txt) + 2)) as i from texts)),
heldout as (select txt, left(md5(txt), 1) < '5' as held from texts),
grams as (select g.*, h.held from grams0 g join heldout h using (txt)),
g as (select gram, count(*) filter (cls = 'allow' and not held) as na, count(*) filter (cls = 'block' and not held) as nr from grams group by gram),
parts as (select gram, na, nr, k, right(gram, k) as s, left(right(gram, k), k - 1) as c from g, (select unnest(range(1, 7)) as k)),
cnt as (select s, k, c, sum(na) as na, sum(nr) as nr from parts where na > 0 or nr > 0 group by s, k, c),
ctx as (select c, k, sum(na) as ca, sum(nr) as cr, count(*) filter (na > 0) as ta, count(*) filter (nr > 0) as tr from cnt group by c, k),
j as (select p.gram, p.k, coalesce(cnt.na, 0)::double as na, coalesce(cnt.nr, 0)::double as nr, coalesce(ca, 0)::double as ca, coalesce(cr, 0)::double as cr, coalesce(ta, 0)::double as ta, coalesce(tr, 0)::double as tr
  from parts p left join cnt on cnt.s = p.s left join ctx on ctx.c = p.c and ctx.k = p.k),
p1 as (select gram, case when ca > 0 then (na + ta / 256.0::double) / (ca + ta) else 1 / 256.0::double end as a, case when cr > 0 then (nr + tr / 256.0::double) / (cr + tr) else 1 / 256.0::double end as r from j where k = 1),
p2 as (select gram, case when ca > 0 then (na + ta * a) / (ca + ta) else a end as a, case when cr > 0 then (nr + tr * r) / (cr + tr) else r end as r from j join p1 using (gram) where k = 2),
p3 as (select gram, case when ca > 0 then (na + ta * a) / (ca + ta) else a end as a, case when cr > 0 then (nr + tr * r) / (cr + tr) else r end as r from j join p2 using (gram) where k = 3),
p4 as (select gram, case when ca > 0 then (na + ta * a) / (ca + ta) else a end as a, case when cr > 0 then (nr + tr * r) / (cr + tr) else r end as r from j join p3 using (gram) where k = 4),
p5 as (select gram, case when ca > 0 then (na + ta * a) / (ca + ta) else a end as a, case when cr > 0 then (nr + tr * r) / (cr + tr) else r end as r from j join p4 using (gram) where k = 5),
p6 as (select gram, floor((ln(case when ca > 0 then (na + ta * a) / (ca + ta) else a end) - ln(case when cr > 0 then (nr + tr * r) / (cr + tr) else r end)) * 1e6 + 0.5)::bigint as llr from j join p5 using (gram) where k = 6),
scored as (select txt, cls, held, floor(sum(llr)::double / count(*))::bigint as score_micro from grams join p6 using (gram) group by txt, cls, held),
bins as (select floor(score_micro / 10000.0::double)::bigint as b, count(*) filter (cls = 'allow') as a, count(*) filter (cls = 'block') as r from scored where held and cls is not null group by 1),
cost as (select b, coalesce(sum(a) over (order by b rows between unbounded preceding and 1 preceding), 0) * sum(r) over ()
    + sum(r) over (order by b rows between current row and unbounded following) * sum(a) over () as cost, sum(a) over () as na, sum(r) over () as nr from bins),
lim as (select coalesce((select b * 10000 from cost where na > 0 and nr > 0 order by cost, abs(b), b limit 1), 0) as lim)
select page_id, host, path, rule, coalesce(j2.cls, case when score_micro >= lim then 'allow' else 'block' end) as verdict, score_micro
from judged j2 join scored s on s.txt = j2.txt, lim
"""
