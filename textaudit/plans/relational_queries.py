"""Queries over the relational and event tables, with their SQL.

The star tables stand in for a history: parts are artifacts, line items references, orders rounds of a customer's document.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textaudit.operators import events as E
from textaudit.operators import history as H
from textaudit.operators import records as R
from textaudit.sources.tables import table

LARGE = 30


def _history(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    artifacts = t("part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("kind"), (F.col("p_size") >= 10).alias("present"), F.col("p_size").cast("long").alias("bytes"))
    refs = t("lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("round_id"))
    rounds = t("orders").select(F.col("o_orderkey").alias("round_id"), F.month("o_orderdate").alias("number"))
    return artifacts, refs, rounds


HISTORY_SQL = """with artifacts as (select p_partkey as path, p_brand as kind, p_size >= 10 as present, p_size::bigint as bytes from part), refs as (select l_partkey as path, l_suppkey as doc_id, l_orderkey as round_id from lineitem),
rounds as (select o_orderkey as round_id, month(o_orderdate)::int as number from orders),
rows0 as (select a.path, kind, present, bytes, count(*) as refs, count(distinct doc_id) as documents, count(distinct r.round_id) as rounds, min(number) as first_round, max(number) as last_round
  from artifacts a join refs r using (path) left join rounds n on n.round_id = r.round_id WHERE group by 1, 2, 3, 4)"""


def artifact_query(spark, sf_dir):
    """Referenced artifacts of two kinds, present, large: one page."""
    a, r, n = _history(spark, sf_dir)
    rows = H.artifact_rows(a, r, n, F.col("kind").isin("Brand#11", "Brand#12") & F.col("present") & (F.col("bytes") >= LARGE))
    return H.page(rows, [F.desc("bytes"), F.desc("refs"), F.asc("kind"), F.asc("path")], 200, 5)


def artifact_totals(spark, sf_dir):
    return H.artifact_stats(H.artifact_rows(*_history(spark, sf_dir)))


def artifact_kinds(spark, sf_dir):
    a, r, n = _history(spark, sf_dir)
    rows = H.artifact_rows(a, r, n, F.col("number") <= 2).where("present")
    return H.kind_stats(rows, a.select("kind").distinct(), "kind", "bytes")


def artifact_rollup(spark, sf_dir):
    a, r, n = _history(spark, sf_dir)
    return a.join(r, "path").join(n, "round_id", "left").rollup("kind", "number").agg(F.count("*").alias("refs"), F.sum("bytes").alias("bytes"))


def orphan_search(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return H.orphans(t("customer"), t("events"), "c_custkey", "user_id")


def latest_round(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return H.latest(o, "o_custkey", "o_orderdate", "o_orderkey")


def upsert_last_wins(spark, sf_dir):
    """Orders of even keys get two changes of status, the later first; the last by sequence replaces the old row."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    change = lambda status, seq: o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit(status)).withColumn("seq", F.lit(seq))
    changes = change("X", 2).unionByName(change("Y", 1))
    return H.upsert(o, changes, "o_orderkey", "seq").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def delete_impact(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), "l_returnflag")
    return H.delete_impact(r, F.col("l_returnflag") == "R")


def next_round(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.month("o_orderdate").alias("number"))
    return H.next_round(o, "o_custkey", "number", 12)


def newest_backups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    return H.keep_newest(o, "o_orderpriority", [F.desc("o_orderdate"), F.desc("o_orderkey")], 10)


def referenced_paths(spark, sf_dir):
    _, r, _ = _history(spark, sf_dir)
    return r.select("path").distinct()


def integrity_counts(spark, sf_dir):
    """Expected cardinalities against the index: one row per check."""
    a, r, n = _history(spark, sf_dir)
    parts = [
        r.join(a, "path", "left_anti").agg(F.count("*").alias("n")).withColumn("check", F.lit("refs_without_artifact")),
        a.join(r, "path", "left_anti").agg(F.count("*").alias("n")).withColumn("check", F.lit("artifacts_without_refs")),
        r.join(n, "round_id", "left_anti").agg(F.count("*").alias("n")).withColumn("check", F.lit("refs_without_round")),
        r.agg(F.count_distinct("path").alias("n")).withColumn("check", F.lit("distinct_paths")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("check", "n")


def derived_refs(spark, sf_dir):
    """References of each customer's last round by month and priority, with what their outputs imply: by role, with the ends of the paths' range."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.month("o_orderdate").alias("number"), F.col("o_orderpriority").alias("profile"), "o_orderdate", "o_orderkey")
    last = R.last_rounds(o, ("o_custkey", "number", "profile"), "o_orderdate", "o_orderkey")
    path = lambda end: F.concat(F.lit(".\\\\out\\\\"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(end))
    last = last.withColumns({"output_path": path(".v1.txt"), "compare_path": path("_compare.json")})
    refs = R.artifact_refs(last, ["o_custkey"], ["output_path", "compare_path"], "output_path", "compare_path")
    # paths are counted by hash first: a distinct count beside the ends sorts every reference, with its path three times
    paths = refs.groupBy("role", "derived", "path").agg(F.count("*").alias("n"))
    return paths.groupBy("role", "derived").agg(F.sum("n").alias("n"), F.count("*").alias("paths"), F.min("path").alias("first"), F.max("path").alias("last"))


_DERIVED = [f"p || '.v1{end}'" for end in R.BESIDE] + [f"'{folder}' || k || '.v1{mark}{end}'" for mark in ("", R.REVIEWED) for folder, end in (*((R.EXPORTS, e) for e in R.EXPORTED), (R.PREFLIGHTS, R.PREFLIGHT))]
REFS_SQL = f"""with o as (select *, row_number() over (partition by o_custkey, month(o_orderdate), o_orderpriority order by o_orderdate desc, o_orderkey desc) as r from orders),
l as (select 'out/' || o_custkey || '/' || o_orderkey as p, o_orderkey::varchar as k from o where r = 1),
f as (select p || '.v1.txt' as path, 'output_path' as role, false as derived from l union all select p || '_compare.json', 'compare_path', false from l
  union all select p || '_compare_review_decisions.json', 'review_decisions', true from l union all select unnest([{', '.join(_DERIVED)}]), 'derived_from_output', true from l)
select role, derived, count(*) as n, count(distinct path) as paths, min(path) as first, max(path) as last from f group by role, derived"""


# --- events -----------------------------------------------------------------------------------------------------------
def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def event_buffer(spark, sf_dir):
    b = E.buffer(_events(spark, sf_dir), "event_type", "event_id")
    return b.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.sum("k").alias("k"))


def events_after_cursor(spark, sf_dir):
    """Each type's events behind a cursor; even users' streams are counted from an old cursor, which truncates."""
    ev = _events(spark, sf_dir)
    last = ev.groupBy("event_type").agg(F.max("event_id").alias("last"))
    cursors = last.select("event_type", F.when(F.length("event_type") % 2 == 0, F.lit(5)).otherwise(F.col("last") - 100).alias("cursor"))
    return E.after_cursor(ev, "event_type", "event_id", cursors, "cursor").select("event_type", "event_id", "truncated")


def run_replies(spark, sf_dir):
    """What each user's client is told behind its cursor (none, an old one, a recent one, one beyond the end), from a buffer of twenty events in which
    views, the progress of four chunks, are coalesced."""
    ev = _events(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") % 4).cast("string").alias("chunk"), F.expr("event_id div 3000").cast("int").alias("round"), (F.col("event_type") == "view").alias("stream"), (F.col("k") > 80).alias("done"))
    kept = E.coalesced_buffer(ev, "user_id", "event_id", "chunk", "round", "stream", "done", 20)
    seen = F.when(F.col("user_id") % 4 == 0, F.lit(None)).when(F.col("user_id") % 4 == 1, F.lit(1)).when(F.col("user_id") % 4 == 2, F.col("n") - 5).otherwise(F.col("n") + 5)
    cursors = ev.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", seen.alias("cursor"))
    return E.replies(kept, "user_id", cursors, "cursor").select("user_id", "seq", "event_id", "snapshot")


def rate_limit(spark, sf_dir):
    r = E.rate_limit(_events(spark, sf_dir), "user_id", "ts", 3600, 1)
    return r.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"), F.max("in_window").alias("most"))


def failure_cooldown(spark, sf_dir):
    c = E.cooldown(_events(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "error")
    return c.where("streak > 0").select("event_id", "user_id", "streak", "cooldown")


def expired_runs(spark, sf_dir):
    done = F.col("event_type").isin("purchase", "click")
    return E.expired(_events(spark, sf_dir), "user_id", "ts", done, F.lit("2024-01-30 12:00:00").cast("timestamp"))


def monotone_progress(spark, sf_dir):
    p = E.progress(_events(spark, sf_dir), "user_id", "event_id", "k")
    return p.groupBy("user_id").agg(F.sum("progress").alias("total"), F.max("progress").alias("most"))


def event_sections(spark, sf_dir):
    s = E.sections(_events(spark, sf_dir), "user_id", "event_id", "event_type")
    return s.groupBy("event_type").agg(F.count("*").alias("sections"), F.max("n").alias("longest"), F.sum("n").alias("events"))


def task_states(spark, sf_dir):
    """Latest event of each user, listed by recency: the most recent forty."""
    ev = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    return H.page(H.latest(ev, "user_id", "ts", "event_id"), [F.desc("ts"), F.desc("event_id")], 40)


def hourly_counts(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k")).select(F.col("w.start").alias("hour"), "event_type", "n", "k")


def turn_coverage(spark, sf_dir):
    """Per conversation, roles in order, whether turns are gapless, and the longest reply."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("gap", F.coalesce(F.col("turn") - F.lag("turn").over(w) - 1, F.lit(0)))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("gap").alias("gaps"), F.max(F.length("text")).alias("longest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role), ",").alias("roles"))


_EV = "ev as (select event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k')::int as k from events)"
_KEEP = f"{_EV}, kept as (select * from ev qualify row_number() over (partition by event_type order by event_id desc) <= 512)"
QUERIES = {
    "derived_refs": (derived_refs, REFS_SQL),
    "artifact_query": (artifact_query, HISTORY_SQL.replace("WHERE", f"where kind in ('Brand#11', 'Brand#12') and present and bytes >= {LARGE}") + " select * from rows0 order by bytes desc, refs desc, kind, path limit 200 offset 5"),
    "artifact_totals": (artifact_totals, HISTORY_SQL.replace("WHERE", "") + " select count(*) as artifacts, count(*) filter (present) as present, count(*) filter (not present) as missing, coalesce(sum(bytes), 0)::bigint as bytes, coalesce(sum(bytes) filter (present), 0)::bigint as present_bytes, count(distinct kind) as kinds, sum(refs)::bigint as refs from rows0"),
    "artifact_kinds": (artifact_kinds, HISTORY_SQL.replace("WHERE", "where number <= 2") + " select k.kind, count(path) as n, coalesce(sum(r.bytes), 0)::bigint as total from (select distinct kind from artifacts) k left join (select * from rows0 where present) r using (kind) group by 1"),
    "artifact_rollup": (artifact_rollup, HISTORY_SQL.replace("WHERE", "") + " select kind, number, count(*) as refs, sum(bytes)::bigint as bytes from artifacts join refs using (path) left join rounds using (round_id) group by rollup (kind, number)"),
    "orphan_search": (orphan_search, "select c_custkey as key, 'left' as side from customer where c_custkey not in (select user_id from events) union all select distinct user_id, 'right' from events where user_id not in (select c_custkey from customer)"),
    "latest_round": (latest_round, "select o_custkey, o_orderdate, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1"),
    "upsert_last_wins": (upsert_last_wins, "select case when o_orderkey % 2 = 0 then 'X' else o_orderstatus end as o_orderstatus, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key from orders group by 1"),
    "delete_impact": (delete_impact, "select l_partkey as path, count(*) filter (l_returnflag = 'R') as deleted_refs, count(*) filter (l_returnflag <> 'R') as kept_refs, count(*) filter (l_returnflag <> 'R') = 0 as removable from lineitem group by 1 having count(*) filter (l_returnflag = 'R') > 0"),
    "next_round": (next_round, "select o_custkey, list_min(list_filter(range(1, 13), lambda m: not list_contains(have, m)))::int as next_round from (select o_custkey, list(distinct month(o_orderdate)) as have from orders group by 1)"),
    "newest_backups": (newest_backups, "select o_orderpriority, o_orderkey, o_orderdate, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc)::int as rank from orders qualify row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) <= 10"),
    "referenced_paths": (referenced_paths, "select distinct l_partkey as path from lineitem"),
    "integrity_counts": (integrity_counts, "select 'refs_without_artifact' as \"check\", count(*) as n from lineitem where l_partkey not in (select p_partkey from part) union all select 'artifacts_without_refs', count(*) from part where p_partkey not in (select l_partkey from lineitem) union all select 'refs_without_round', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'distinct_paths', count(distinct l_partkey) from lineitem"),
    "event_buffer": (event_buffer, f"with {_KEEP} select event_type, count(*) as n, min(event_id) as first_id, max(event_id) as last_id, sum(k)::bigint as k from kept group by 1"),
    "events_after_cursor": (events_after_cursor, f"with {_KEEP}, cur as (select event_type, case when length(event_type) % 2 = 0 then 5 else max(event_id) - 100 end as cursor from ev group by 1), f as (select event_type, min(event_id) as first from kept group by 1) select event_type, event_id, exists (select 1 from ev where ev.event_type = kept.event_type and ev.event_id > cursor and ev.event_id < f.first) as truncated from kept join cur using (event_type) join f using (event_type) where event_id > cursor"),
    "run_replies": (run_replies, f"""with {_EV}, e as (select *, row_number() over (partition by user_id order by event_id) as seq, lead(event_type) over c as next_type, lead(event_id // 3000) over c as next_round from ev window c as (partition by user_id, event_id % 4 order by event_id)),
      kept as (select user_id, event_id, seq from e where not (event_type = 'view' and k <= 80 and coalesce(next_type = 'view' and next_round = event_id // 3000, false)) qualify row_number() over (partition by user_id order by seq desc) <= 20),
      b as (select user_id, min(seq) as first, max(seq) as last from kept group by 1), n as (select user_id, count(*) as n from ev group by 1),
      s as (select b.*, case user_id % 4 when 0 then first - 1 when 1 then least(1, last) when 2 then least(n - 5, last) else least(n + 5, last) end as seen from b join n using (user_id))
      select user_id, seq, event_id, seen < first - 1 as snapshot from kept join s using (user_id) where case when seen < first - 1 then seq = last else seq > seen end"""),
    "rate_limit": (rate_limit, f"with {_EV}, w as (select user_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as c from ev) select user_id, count(*) filter (c <= 1) as allowed, count(*) filter (c > 1) as refused, max(c) as most from w group by 1"),
    "failure_cooldown": (failure_cooldown, f"with {_EV}, a as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id) as ok from ev), b as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, ok order by event_id) as streak from a) select event_id, user_id, streak::bigint as streak, least(60, streak * 3)::bigint as cooldown from b where streak > 0"),
    "expired_runs": (expired_runs, f"with {_EV}, l as (select * from ev qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select user_id, ts as last_ts from l where event_type in ('purchase', 'click') and ts < timestamp '2024-01-30 12:00:00' - interval 1800 seconds"),
    "monotone_progress": (monotone_progress, f"with {_EV}, p as (select user_id, max(k) over (partition by user_id order by event_id) as p from ev) select user_id, sum(p)::bigint as total, max(p) as most from p group by 1"),
    "event_sections": (event_sections, f"with {_EV}, a as (select *, case when event_type = lag(event_type) over w then 0 else 1 end as new from ev window w as (partition by user_id order by event_id)), s as (select user_id, event_type, sum(new) over (partition by user_id order by event_id) as section from a), r as (select user_id, section, any_value(event_type) as event_type, count(*) as n from s group by 1, 2) select event_type, count(*) as sections, max(n) as longest, sum(n)::bigint as events from r group by 1"),
    "task_states": (task_states, f"with {_EV}, l as (select user_id, ts, event_id, event_type from ev qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select * from l order by ts desc, event_id desc limit 40"),
    "hourly_counts": (hourly_counts, f"with {_EV} select date_trunc('hour', ts)::timestamp as hour, event_type, count(*) as n, sum(k)::bigint as k from ev group by 1, 2"),
    "turn_coverage": (turn_coverage, "with c as (select *, coalesce(turn - lag(turn) over (partition by conv_id order by turn) - 1, 0) as gap from conversations) select conv_id, count(*) as turns, sum(gap)::bigint as gaps, max(length(text)) as longest, string_agg(role, ',' order by turn) as roles from c group by 1"),
}
