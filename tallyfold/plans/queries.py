"""Queries over the given tables, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.operators import chain, compare, jobs, lineage, reads, rules, workflow
from tallyfold.plans import views
from tallyfold.plans.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_UNPAIRED = [(f"{e}-{t}", e, "R", t, "price", "unpaired", "student_t", None, None, "bonferroni", 500.0) for e in "FO" for t in "AN"]

_WELCH = """
with r as (select l_linestatus e, l_returnflag a, count(*) n, avg(l_extendedprice) m, stddev_samp(l_extendedprice) s,
                  var_samp(l_extendedprice) v, min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem group by 1, 2),
c as (select * from (values ('F-A', 'F', 'A'), ('F-N', 'F', 'N'), ('O-A', 'O', 'A'), ('O-N', 'O', 'N')) x(comparison_id, e, arm)),
j as (select c.comparison_id, c.e, c.arm, t.n n_t, t.m mean_t, t.s sd_t, t.lo min_t, t.hi max_t, t.v v_t,
             k.n n_c, k.m mean_c, k.s sd_c, k.lo min_c, k.hi max_c, k.v v_c
      from c join r t on t.e = c.e and t.a = c.arm join r k on k.e = c.e and k.a = 'R')
select comparison_id, e as experiment_id, arm as treatment_arm, 'R' as control_arm, n_t, n_c,
       round(mean_t, 6) mean_t, round(mean_c, 6) mean_c, round(sd_t, 6) sd_t, round(sd_c, 6) sd_c, min_t, min_c, max_t, max_c,
       round(mean_t - mean_c, 6) estimate,
       round((mean_t - mean_c) / sqrt(((n_t - 1) * v_t + (n_c - 1) * v_c) / (n_t + n_c - 2)), 6) std_estimate,
       round(1 - 0.05::double / 4, 6) effective_level,
       round(sqrt(v_t / n_t + v_c / n_c), 6) se,
       round((v_t / n_t + v_c / n_c) ** 2 / ((v_t / n_t) ** 2 / (n_t - 1) + (v_c / n_c) ** 2 / (n_c - 1)), 4) df,
       abs(mean_t - mean_c) >= 500 as exceeds
from j
"""


@query(_WELCH)
def compare_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the treatment arm differ from the control, in each experiment: descriptives, effect, Welch error and degrees of freedom."""
    out = compare.compare(views.line_runs(spark, sf_dir), views.registered(spark, _UNPAIRED), intervals=False)
    keep = ["comparison_id", "experiment_id", "treatment_arm", "control_arm", "n_t", "n_c", "mean_t", "mean_c", "sd_t", "sd_c", "min_t", "min_c", "max_t", "max_c", "estimate", "std_estimate", "effective_level", "se", "df", "exceeds"]
    return _rounded(out.select(*keep).withColumn("df", F.round("df", 4)))


# Student's t from the normal quantile by its expansion in 1 / df, which is exact to 1e-9 at these degrees of freedom.
_T = "(z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3) + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * df**4))"


@query(
    f"""with r as (select l_linestatus e, l_returnflag a, count(*) n, avg(l_extendedprice) m, var_samp(l_extendedprice) / count(*) v from lineitem group by 1, 2),
c as (select * from (values ('F-A', 'F', 'A'), ('F-N', 'F', 'N'), ('O-A', 'O', 'A'), ('O-N', 'O', 'N')) x(comparison_id, e, arm)),
j as (select comparison_id, t.m - k.m estimate, sqrt(t.v + k.v) se, (t.v + k.v) ** 2 / (t.v ** 2 / (t.n - 1) + k.v ** 2 / (k.n - 1)) df, 2.497705474412296::double z
      from c join r t on t.e = c.e and t.a = c.arm join r k on k.e = c.e and k.a = 'R')
select comparison_id, round(estimate, 4) estimate, round(1 - 0.05::double / 4, 6) effective_level, round(df, 3) df, round(estimate - {_T} * se, 4) lower, round(estimate + {_T} * se, 4) upper, 'student_t' unc_method from j"""
)
def compare_unpaired_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.compare(views.line_runs(spark, sf_dir), views.registered(spark, _UNPAIRED))
    four = [F.round(c, 4).alias(c) for c in ("estimate", "lower", "upper")]
    return out.select("comparison_id", four[0], F.round("effective_level", 6).alias("effective_level"), F.round("df", 3).alias("df"), *four[1:], "unc_method")


@query(
    f"""with v as (select user_id, event_type, avg(value) v from events group by 1, 2),
d as (select t.event_type c, t.v - k.v d from v t join v k on k.user_id = t.user_id and k.event_type = 'view' where t.event_type in ('click', 'purchase', 'error')),
j as (select c, avg(d) estimate, stddev_samp(d) / sqrt(count(*)) se, count(*) - 1 df, 1.959963984540054::double z from d group by 1)
select c as comparison_id, round(estimate, 4) estimate, round(estimate - {_T} * se, 4) lower, round(estimate + {_T} * se, 4) upper from j where df > 30"""
)
def compare_paired_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of paired differences; those of few pairs are held against printed tables in the tests."""
    out = compare.compare(views.event_runs(spark, sf_dir), views.registered(spark, _PAIRED)).where("problem is null and df > 30")
    return out.select("comparison_id", *(F.round(c, 4).alias(c) for c in ("estimate", "lower", "upper")))


_PAIRED = [(f"{t}", "E", "view", t, "value", "paired", "student_t", None, None, "none", None) for t in ("click", "purchase", "error")]


@query(
    """
with v as (select user_id, event_type, avg(value) v from events group by 1, 2),
d as (select t.event_type c, t.user_id, t.v - k.v d from v t join v k on k.user_id = t.user_id and k.event_type = 'view'
      where t.event_type in ('click', 'purchase', 'error'))
select c as comparison_id, count(*) n_d, round(avg(d), 6) estimate, round(stddev_samp(d), 6) sd_d,
       round(avg(d) / stddev_samp(d), 6) std_estimate, round(stddev_samp(d) / sqrt(count(*)), 6) se, (count(*) - 1)::double df
from d group by c
"""
)
def compare_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.compare(views.event_runs(spark, sf_dir), views.registered(spark, _PAIRED), intervals=False)
    return _rounded(out.where("problem is null").select("comparison_id", "n_d", "estimate", "sd_d", "std_estimate", "se", "df"))


_DRAW = " ".join(["(" * 8, "0"] + [f"* 4294967296 + ('0x' || substr(h, {8 * i + 1}, 8))::bigint) % g.n" for i in range(8)])


@query(
    f"""
with v as (select user_id, event_type, avg(value) v from events group by 1, 2),
d as (select row_number() over (order by t.user_id) - 1 i, count(*) over () n, t.v - k.v d
      from v t join v k on k.user_id = t.user_id and k.event_type = 'view' where t.event_type = 'click'),
n as (select max(n) n from d),
g as (select b.b, n.n, sha256('17:' || (b.b * n.n + i.i)) h from n, range(1000) b(b), lateral (select unnest(range(n.n)) i) i),
m as (select g.b, avg(d.d) m from g join d on d.i = {_DRAW} group by 1)
select 'click' as comparison_id, round(quantile_cont(m, 0.025), 6) lower, round(quantile_cont(m, 0.975), 6) upper from m
"""
)
def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = views.registered(spark, [("click", "E", "view", "click", "value", "paired", "bootstrap", 17, 1000, "none", None)])
    values = compare.observations(views.event_runs(spark, sf_dir), spec)
    out = compare.bootstrap(values, spec.withColumn("effective", F.col("level")))
    return _rounded(out.select("comparison_id", "lower", "upper"))


_STATUS = """r as (select user_id::varchar p, lpad(event_id::varchar, 10, '0') id, event_type = 'error' failed,
  (json_extract_string(props, '$.k')::int) k from events),
s as (select *, not failed and k % 10 <> 0 inc, case when failed then 'FAILED' else 'COMPLETED' end st from r)"""


@query(
    f"""with {_STATUS}
select p as protocol_id, count(*) n_all, count(*) filter (inc) n_included, count(*) filter (not inc) n_excluded, count(*) filter (failed) n_failed,
       sha256(string_agg(id, ',' order by id) filter (not inc)) excluded_digest from s group by 1"""
)
def run_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = views.status_runs(spark, sf_dir)
    none = runs.select("ledger_id", "protocol_id", "run_id").where("false")
    out = compare.inventory(runs, none)
    n = lambda c: F.size(c).cast("long")
    text = F.when(F.size("excluded_runs") > 0, F.sha2(F.array_join("excluded_runs", ","), 256))
    return out.select("protocol_id", n("all_runs").alias("n_all"), n("included_runs").alias("n_included"), n("excluded_runs").alias("n_excluded"), n("failed_runs").alias("n_failed"), text.alias("excluded_digest"))


@query(
    f"""with {_STATUS}
select p as protocol_id, id as run_id, st as status, coalesce(nullif(case when k = 0 then 'zero' when k = 10 then '' end, ''), 'Run status is ' || st) reason,
       p || '#analysis-plan' as policy_reference from s where not inc"""
)
def run_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.exclusions(views.status_runs(spark, sf_dir)).drop("ledger_id")


@query("select count(*) n, min(doc_id) least, max(doc_id) largest, sum(doc_id)::bigint total from documents where doc_id not in (select doc_id from labels)")
def expected_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t: table(spark, sf_dir, t).select(F.lit("L").alias("ledger_id"), F.lit("P").alias("protocol_id"), F.col("doc_id").alias("run_id"))
    return compare.missing_runs(ids("labels"), ids("documents")).agg(F.count("*").alias("n"), F.min("run_id").alias("least"), F.max("run_id").alias("largest"), F.sum("run_id").alias("total"))


@query("select o_orderkey as run_id from orders where o_orderkey not in (select l_orderkey from lineitem)")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda t, c: table(spark, sf_dir, t).select(F.lit("L").alias("ledger_id"), F.lit("P").alias("protocol_id"), F.col(c).alias("run_id"))
    return compare.missing_runs(key("lineitem", "l_orderkey"), key("orders", "o_orderkey")).select("run_id")


@query(
    f"""with {_STATUS},
v as (select p, 'value' metric, count(*) n, avg(value) m, coalesce(stddev_samp(value), 0) sd
      from s join events e on e.event_id = s.id::bigint where inc group by 1)
select p as protocol_id, metric, n, round(m, 6) mean, round(m - 1.96::double * sd / sqrt(n), 6) lower, round(m + 1.96::double * sd / sqrt(n), 6) upper from v"""
)
def legacy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.legacy_summary(views.status_runs(spark, sf_dir)).select("protocol_id", "metric", "n", "mean", "lower", "upper"))


@query(
    """select l_orderkey as ledger_id, count(*) n, min(l_linenumber)::bigint least, max(l_linenumber)::bigint largest, count(*) > count(distinct l_linenumber) repeated,
       max(l_linenumber) > count(distinct l_linenumber) gapped,
       count(*) = count(distinct l_linenumber) and min(l_linenumber) = 1 and max(l_linenumber) = count(*) contiguous from lineitem group by 1"""
)
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ledger_id"), F.col("l_linenumber").cast("long").alias("sequence"))
    return chain.sequence_gaps(rows)


@query(
    """select conv_id as ledger_id, count(*) n, min(turn) least, max(turn) largest, count(*) > count(distinct turn) repeated,
       max(turn) + 1 > count(distinct turn) gapped, count(*) = count(distinct turn) and min(turn) = 0 and max(turn) = count(*) - 1 contiguous
       from conversations group by 1"""
)
def conversation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.sequence_gaps(table(spark, sf_dir, "conversations"), start=0, by="conv_id", sequence="turn").withColumnRenamed("conv_id", "ledger_id")


_LEDGER = """b as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) q, sha256(event_id || '|' || event_type) body from events),
f as (select user_id, list(body order by q) l from b group by 1),
u as (select user_id, unnest(range(1, len(l) + 1)) q, l from f),
e as (select user_id, q, list_reduce(list_prepend('', l[1:q]), lambda a, x: sha256(a || x)) d from u),
c as (select b.user_id, b.event_id, b.q, b.body, e.d, p.d prev from b join e using (user_id, q) left join e p on p.user_id = b.user_id and p.q = b.q - 1)"""


@query(f"with {_LEDGER} select user_id as ledger_id, event_id, q as sequence, body as body_digest, prev as previous, d as digest from c")
def chained_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.user_ledger(spark, sf_dir).select("ledger_id", "event_id", "sequence", "body_digest", "previous", "digest")


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' ledgers with a link spoilt in every 97th event and a body in every 89th."""
    rows = views.user_ledger(spark, sf_dir)
    rows = rows.withColumn("previous", F.when(F.col("event_id") % 97 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("previous")))
    return rows.withColumn("event_type", F.when(F.col("event_id") % 89 == 0, "changed").otherwise(F.col("event_type")))


@query(
    """with b as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) q from events)
select user_id as ledger_id, q as sequence, 'broken link' as rule from b where event_id % 97 = 0
union all select user_id, q, 'digest' from b where event_id % 97 = 0
union all select user_id, q, 'body digest' from b where event_id % 89 = 0"""
)
def chain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tampered(spark, sf_dir)
    return chain.broken_links(rows).unionByName(chain.wrong_digests(rows, views.body()).select("ledger_id", "sequence", "rule"))


@query(
    """with b as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) q from events),
v as (select user_id, min(q) q from b where event_id % 97 = 0 or event_id % 89 = 0 group by 1)
select b.user_id as ledger_id, count(*) filter (v.q is null or b.q < v.q) valid_rows, min(v.q) first_violation from b left join v using (user_id) group by 1"""
)
def valid_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tampered(spark, sf_dir)
    found = chain.broken_links(rows).withColumn("object_id", F.lit("")).unionByName(chain.wrong_digests(rows, views.body()))
    kept = chain.valid_prefix(rows, found).groupBy("ledger_id").agg(F.count("*").alias("valid_rows"))
    first = chain.first_violations(found).select("ledger_id", F.col("sequence").alias("first_violation"))
    every = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger_id")).distinct()
    return every.join(kept, "ledger_id", "left").join(first, "ledger_id", "left").na.fill(0, ["valid_rows"])


@query(
    """with b as (select user_id, count(*) n from events group by 1)
select user_id as ledger_id, case user_id % 4 when 0 then 'HEALTHY' when 1 then 'RECOVERABLE' when 2 then 'REMOVED' else 'REWRITTEN' end status,
  case user_id % 4 when 1 then n - 2 when 2 then n + 1 else n end committed, case user_id % 4 when 1 then 2 else 0 end::bigint tail from b"""
)
def recovery_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of every kind: at the end, two rows before it, past it, and with another digest."""
    rows = views.user_ledger(spark, sf_dir)
    last = rows.groupBy("ledger_id").agg(F.count("*").alias("n"))
    kind = F.col("ledger_id") % 4
    at = F.when(kind == 1, F.col("n") - 2).when(kind == 2, F.col("n") + 1).otherwise(F.col("n"))
    want = last.select("ledger_id", at.alias("event_count"))
    anchors = want.join(rows.select("ledger_id", F.col("sequence").alias("event_count"), "digest"), ["ledger_id", "event_count"], "left")
    anchors = anchors.select("ledger_id", "event_count", F.when(kind == 3, F.lit("other")).otherwise(F.col("digest")).alias("terminal_receipt_sigil"))
    return chain.recovery(rows, anchors)


_TURNS = [("user", "assistant"), ("assistant", "user"), ("system", "user")]


@query(
    """with r as (select conv_id, turn, case when (conv_id * 7 + turn) % 11 = 3 then 'system' else role end as role from conversations),
t as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) p from r)
select conv_id as ledger_id, turn as sequence, coalesce(p, 'user') as source, role from t
where p is not null and (p, role) not in (('user', 'assistant'), ('assistant', 'user'), ('system', 'user'))"""
)
def bad_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which some turns are made the system's."""
    allowed = spark.createDataFrame(_TURNS, "source string, target string")
    role = F.when((F.col("conv_id") * 7 + F.col("turn")) % 11 == 3, "system").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ledger_id"), F.col("turn").alias("sequence"), role.alias("role"))
    return rules.bad_transitions(rows, allowed, ["ledger_id"], "role", ["sequence"]).select("ledger_id", "sequence", "source", "role")


@query(
    """with t as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) p from events)
select user_id as ledger_id, event_id, p as source, event_type from t where p is not null and (p, event_type) not in
(('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('click', 'view'), ('purchase', 'view'))"""
)
def bad_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view")], "source string, target string")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger_id"), "ts", "event_id", "event_type")
    return rules.bad_transitions(rows, allowed, ["ledger_id"], "event_type", ["ts", "event_id"]).select("ledger_id", "event_id", "source", "event_type")


@query(
    """select user_id, arg_max(event_type, (ts, event_id)) state, count(*) steps, sha256(string_agg(event_type, ',' order by event_id)) history_digest
from events group by 1"""
)
def current_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("event_id"))
    out = rules.current_state(rows, ["user_id"], "event_type", "at")
    return out.select("user_id", "state", F.size("history").cast("long").alias("steps"), F.sha2(F.array_join("history", ","), 256).alias("history_digest"))


@query(
    """with r as (select o_custkey, max(case o_orderstatus when 'O' then 1 when 'P' then 2 when 'F' then 3 end) r, string_agg(o_orderkey, ',' order by o_orderdate, o_orderkey) ids from orders group by 1)
select o_custkey as ledger_id, r as rank, case r when 1 then 'O' when 2 then 'P' else 'F' end status, sha256(ids) ids_digest from r"""
)
def highest_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "ledger_id")
    ids = rows.groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("x")).select("ledger_id", F.sha2(F.array_join(F.transform("x", lambda s: s["o_orderkey"].cast("string")), ","), 256).alias("ids_digest"))
    return rules.highest_status(rows, ["ledger_id"], "o_orderstatus", ["O", "P", "F"]).join(ids, "ledger_id")


@query(
    """with f as (select user_id, event_id, ts, event_type = 'purchase' flag from events),
w as (select *, max(flag) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) b from f)
select user_id, count(*) lowered from w where b and not flag group by 1"""
)
def lowered_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("flag", F.col("event_type") == "purchase")
    return rules.lowered_flags(rows, ["user_id"], "flag", "event_id").groupBy("user_id").agg(F.count("*").alias("lowered"))


@query("select sha256(text) digest, min(doc_id) first_id, count(*) copies, min(length(text)) length, false as collides from documents group by 1")
def blob_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfold.sources.ledger import distinct_blobs

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.encode("text", "utf-8"), 256).alias("digest"), F.length("text").cast("long").alias("length"))
    return distinct_blobs(rows).withColumnRenamed("path", "first_id")


@query(
    """select result, count(*) n from (select case when page_id % 11 = 0 then 'MISSING' when page_id % 7 = 0 then 'MISMATCH' else 'OK' end result from pages) group by 1"""
)
def content_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered digests of pages against the pages, some of which are gone or edited."""
    pages = table(spark, sf_dir, "pages")
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256).alias("digest")
    registered = pages.select(F.col("page_id").alias("path"), digest("html"))
    actual = pages.where("page_id % 11 <> 0").select(F.col("page_id").alias("path"), digest(F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))))
    return reads.content_audit(registered, actual).groupBy("result").agg(F.count("*").alias("n"))


@query(
    """select l_orderkey as ref, l_linenumber, l_shipdate as sequence from lineitem l left join orders o on o_orderkey = l_orderkey
where o_orderkey is null or o_orderkey % 50 = 0 or o_orderdate >= l_shipdate"""
)
def references_before_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders that don't exist yet (or any more: every 50th is taken out)."""
    uses = table(spark, sf_dir, "lineitem").select(F.lit("L").alias("ledger_id"), F.col("l_shipdate").alias("sequence"), F.col("l_orderkey").alias("ref"), "l_linenumber")
    made = table(spark, sf_dir, "orders").where("o_orderkey % 50 <> 0").select(F.lit("L").alias("ledger_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("sequence"))
    return rules.unknown_references(uses, made).select("ref", "l_linenumber", "sequence")


@query("select l_orderkey as ref, l_linenumber, l_suppkey % 5 as program_id from lineitem join orders on o_orderkey = l_orderkey where l_suppkey % 5 <> o_custkey % 5")
def references_across_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").select(F.lit("L").alias("ledger_id"), (F.col("l_suppkey") % 5).alias("program_id"), F.col("l_orderkey").alias("ref"), "l_linenumber")
    made = table(spark, sf_dir, "orders").select(F.lit("L").alias("ledger_id"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("program_id"))
    return rules.foreign_references(uses, made).select("ref", "l_linenumber", "program_id")


@query("select l_orderkey, l_linenumber, count(*) - 1 as again from (select l_orderkey, l_linenumber from lineitem) group by 1, 2 having count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("sequence", F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", F.monotonically_increasing_id().alias("i")))
    out = rules.duplicates(rows.withColumn("sequence", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("sequence"))), ["l_orderkey", "l_linenumber"])
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("again"))


@query(
    """with d as (select o_orderkey id, o_custkey p, o_orderdate t from orders),
i as (select o_orderkey id, o_custkey p, o_orderdate a, case when o_orderkey % 3 <> 0 then o_orderdate + interval 400 day end b from orders)
select d.id as moment_id, count(i.id) n_open, sha256(coalesce(string_agg(i.id, ',' order by i.id), '')) open_digest
from d left join i on i.p = d.p and i.a < d.t and (i.b is null or i.b > d.t) group by 1"""
)
def open_at_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    moments = orders.select(F.col("o_orderkey").alias("moment_id"), F.col("o_custkey").alias("program_id"), F.col("o_orderdate").alias("at"))
    spans = orders.select(F.col("o_orderkey").alias("interval_id"), F.col("o_custkey").alias("program_id"), F.col("o_orderdate").alias("opened"), F.expr("case when o_orderkey % 3 <> 0 then o_orderdate + interval 400 days end").alias("closed"))
    out = rules.open_at(moments, spans, ["program_id"])
    return out.select("moment_id", F.size("open_ids").cast("long").alias("n_open"), F.sha2(F.array_join(F.transform("open_ids", lambda x: x.cast("string")), ","), 256).alias("open_digest"))


_OLD, _NEW = "c_custkey % 10 <> 1", "c_custkey % 10 <> 2"


@query(
    """with o as (select c_custkey k, sha256(c_name || '|' || c_mktsegment) d from customer where c_custkey % 10 <> 1),
n as (select c_custkey k, sha256(c_name || '|' || case when c_custkey % 10 = 3 then 'X' else c_mktsegment end) d from customer where c_custkey % 10 <> 2)
select coalesce(o.k, n.k) object_id, case when o.k is null then 'ADDED' when n.k is null then 'REMOVED' else 'CHANGED' end change
from o full join n on o.k = n.k where o.d is distinct from n.d"""
)
def snapshot_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    inventory = lambda df, seg: df.select(F.lit("L").alias("ledger_id"), F.lit("customer").alias("object_type"), F.col("c_custkey").alias("object_id"), F.sha2(F.concat_ws("|", "c_name", seg), 256).alias("digest"))
    edited = F.when(F.col("c_custkey") % 10 == 3, "X").otherwise(F.col("c_mktsegment"))
    return lineage.freshness(inventory(rows.where(_OLD), F.col("c_mktsegment")), inventory(rows.where(_NEW), edited)).select("object_id", "change")


@query(
    """with o as (select c_custkey, c_mktsegment from customer where c_custkey % 10 <> 1),
n as (select c_custkey, case when c_custkey % 10 = 3 then 'X' else c_mktsegment end c_mktsegment from customer where c_custkey % 10 <> 2)
select *, 'before' as side from (from o except all from n) union all select *, 'after' from (from n except all from o)"""
)
def state_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    edited = F.when(F.col("c_custkey") % 10 == 3, "X").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    return chain.unchanged(rows.where(_OLD).select("c_custkey", "c_mktsegment"), rows.where(_NEW).select("c_custkey", edited))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, own, a: table(spark, sf_dir, n).select(F.lit("L").alias("ledger_id"), F.concat(F.lit(f"{n}:"), own).alias("id"), a.alias("to"))
    ref = lambda n, c: F.concat(F.lit(f"{n}:"), F.col(c))
    return lineage.edges(
        {
            "lineitem": (t("lineitem", F.concat_ws("-", "l_orderkey", "l_linenumber"), ref("orders", "l_orderkey")), "id", {"to": "of order"}),
            "orders": (t("orders", F.col("o_orderkey"), ref("customer", "o_custkey")), "id", {"to": "by customer"}),
            "customer": (t("customer", F.col("c_custkey"), ref("nation", "c_nationkey")), "id", {"to": "from nation"}),
            "nation": (t("nation", F.col("n_nationkey"), ref("region", "n_regionkey")), "id", {"to": "in region"}),
        }
    )


_EDGES = """e as (select distinct 'lineitem:' || l_orderkey || '-' || l_linenumber src, 'orders:' || l_orderkey dst from lineitem
union select 'orders:' || o_orderkey, 'customer:' || o_custkey from orders union select 'customer:' || c_custkey, 'nation:' || c_nationkey from customer
union select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation)"""


@query(
    f"""with recursive {_EDGES}, s as (select distinct src id from e where src like 'orders:%' and substr(src, 8)::bigint % 100 = 0),
r(root, node, depth) as (select id, id, 0 from s union select r.root, e.dst, r.depth + 1 from r join e on e.src = r.node)
select root, node, min(depth) depth from r group by 1, 2"""
)
def lineage_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.lit("L").alias("ledger_id"), F.concat(F.lit("orders:"), "o_orderkey").alias("id"))
    return lineage.closure(_edges(spark, sf_dir), start).select("root", "node", "depth")


@query(
    f"""with recursive {_EDGES}, r(root, node, depth) as (select 'nation:' || n_nationkey, 'nation:' || n_nationkey, 0 from nation
union select r.root, e.src, r.depth + 1 from r join e on e.dst = r.node)
select root, depth, count(distinct node) n from r group by 1, 2"""
)
def lineage_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "nation").select(F.lit("L").alias("ledger_id"), F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    return lineage.reach_counts(_edges(spark, sf_dir), start, up=True).select("root", "depth", "n")


@query(
    """with recursive p as (select event_id id, case when event_id > 0 then event_id - 1 - (event_id * 7919 % least(event_id, 50)) end parent from events),
r(id, node) as (select id, id from p union all select r.id, p.parent from r join p on p.id = r.node where p.parent is not null)
select id, min(node) as root from r where id in (select event_id from events) group by 1"""
)
def lineage_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first producer behind each event, where an event's producer is one of the 50 before it."""
    e = F.col("event_id")
    parent = F.when(e > 0, e - 1 - (e * 7919 % F.least(e, F.lit(50))))
    rows = table(spark, sf_dir, "events").select(F.lit("L").alias("ledger_id"), e.alias("id"), parent.alias("parent"))
    return lineage.roots(rows).select("id", "root")


@query(
    """select o_orderkey as sequence, v.value from orders, lateral (select unnest([o_orderkey::varchar, 'c' || o_custkey, 'p' || o_orderpriority[1:1], o_orderstatus]) as value) v
where v.value = 'c1' or v.value = 'p1' or v.value = 'c2'"""
)
def trace_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events whose payload nests ids at three depths; those that mention some ids."""
    nested = F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)))
    payload = F.to_json(F.struct(F.struct(nested.alias("in")).alias("a"), F.col("o_orderstatus").alias("b")))
    events = table(spark, sf_dir, "orders").select(F.lit("L").alias("ledger_id"), F.col("o_orderkey").alias("sequence"), F.col("o_orderkey").cast("string").alias("object_id"), payload.alias("payload"))
    ids = spark.createDataFrame([("L", x) for x in ("c1", "p1", "c2")], "ledger_id string, id string")
    return lineage.trace(lineage.references(events), ids).select("sequence", F.col("id").alias("value"))


@query(
    """with t as (select c_custkey k, case when c_custkey % 17 = 0 then 'tk-' else 'TK-' end || c_custkey task, c_custkey % 19 <> 0 host, (c_custkey % 7)::varchar cap, c_custkey % 13 <> 0 ok, case when c_custkey % 5 = 0 then ['read', 'net'] else ['read'] end tools,
  c_custkey % 11 = 0 net, (c_custkey % 40 - 2)::bigint s, c_custkey % 3 = 0 appr from customer),
c as (select i::varchar cap, i <> 6 tok, case when i < 4 then ['read', 'net'] else ['read'] end allowed, i in (1, 2) anet, 30 mx, i in (2, 3) need from range(7) r(i)),
v as (select k, task, case when k % 17 = 0 or not host then 'identifiers' when not ok then 'digest' when not tok then 'contract' when len(list_filter(tools, lambda x: not list_contains(allowed, x))) > 0 then 'tools'
  when s < 1 then 'no time' when s > mx then 'too much time' when net and not anet then 'network' when need and not appr then 'approval needed'
  when need and k % 6 = 0 then 'approval differs' end reason from t join c using (cap))
select task as task_id, case when reason is null then 'PASS' when reason = 'approval needed' then 'WAITING_FOR_APPROVAL' else 'REJECTED' end verdict, reason from v"""
)
def policy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    arr = lambda *x: F.array(*(F.lit(v) for v in x))
    capsules = table(spark, sf_dir, "customer").select(
        F.lit("L").alias("ledger_id"), k.alias("k"), F.concat(F.when(k % 17 == 0, "tk-").otherwise("TK-"), k.cast("string")).alias("task_id"), F.when(k % 19 == 0, "x").otherwise("h").alias("host"), (k % 7).cast("string").alias("capability_id"), F.lit("1").alias("contract_version"), F.concat(F.lit("d"), (k % 7).cast("string")).alias("contract_digest"), arr("note").alias("expected_outputs"),
        F.when(k % 5 == 0, arr("read", "net")).otherwise(arr("read")).alias("tools"), (k % 11 == 0).alias("network"), (k % 40 - 2).alias("seconds"), F.sha2(k.cast("string"), 256).alias("digest"), (k % 13 != 0).alias("digest_ok"),
    )
    contracts = spark.createDataFrame([(str(i), "1", f"d{i}" if i != 6 else "new", ["note"], ["read", "net"] if i < 4 else ["read"], i in (1, 2), 30, i in (2, 3)) for i in range(7)], "capability_id string, version string, digest string, outputs array<string>, allowed_tools array<string>, allows_network boolean, max_seconds long, needs_approval boolean")
    approvals = capsules.where("k % 3 = 0").select("ledger_id", "task_id", "capability_id", "contract_digest", F.when(F.col("k") % 6 == 0, F.lit("other")).otherwise(F.col("digest")).alias("digest"), "tools", "network", "seconds")
    return rules.verdicts(capsules, contracts, approvals, hosts=["h"]).select("task_id", "verdict", "reason")


@query("select p_partkey, p_name from part order by p_partkey limit 50 offset 100")
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", limit=50, offset=100)


@query("select p_partkey, p_name from part where p_partkey > 149 order by p_partkey limit 50")
def listing_page_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", limit=50, after=149)


@query("select event_id as sequence, event_type from events where event_id > 20 and event_id <= 60 order by event_id limit 25")
def observed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.observed(table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), "event_type"), 20, 60, 25)


@query("select p_partkey, p_name, p_type from part where contains(lower(p_name), 'ring') or contains(lower(p_type), 'ring')")
def definition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.search(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "RING")


@query(
    """with o as (select 'orders' c, 0 r, o_orderkey id from orders union all select 'customer', 1, c_custkey from customer union all select 'part', 2, p_partkey from part)
select id::varchar object_id, arg_min(c, r) collection from o group by 1"""
)
def object_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in orders, customers and parts: the first collection that has one."""
    with_ledger = lambda n, c: table(spark, sf_dir, n).select(F.lit("L").alias("ledger_id"), F.col(c))
    every = reads.objects({"orders": (with_ledger("orders", "o_orderkey"), "o_orderkey"), "customer": (with_ledger("customer", "c_custkey"), "c_custkey"), "part": (with_ledger("part", "p_partkey"), "p_partkey")})
    ids = every.select("ledger_id", "object_id").distinct()
    return reads.look_up(every, ids).select("object_id", "collection")


@query("select 'orders' collection, count(*) n, min(o_orderkey)::varchar first_id from orders union all select 'customer', count(*), min(c_custkey)::varchar from customer")
def object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_ledger = lambda n, c: table(spark, sf_dir, n).select(F.lit("L").alias("ledger_id"), F.col(c))
    every = reads.objects({"orders": (with_ledger("orders", "o_orderkey"), "o_orderkey"), "customer": (with_ledger("customer", "c_custkey"), "c_custkey")})
    return every.groupBy("collection").agg(F.count("*").alias("n"), F.min(F.col("object_id").cast("long")).cast("string").alias("first_id"))


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a job journal: a user's job in each block of 8 rows of the user; types become steps by the row's place."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").withColumn("p", place).withColumn("job", F.floor(F.col("p") / 8))
    step = F.col("p") % 8
    kind = F.when(step == 0, "job.submitted").when((step == 1) | (F.col("event_type") == "view"), "job.queued").when(F.col("event_type") == "click", "job.cancellation_requested").otherwise("job.terminal")
    return rows.select(
        F.col("user_id").alias("ledger_id"), (F.col("p") + 1).cast("long").alias("sequence"), "event_id", kind.alias("event_type"), F.lit("").alias("event_digest"), F.concat_ws("-", "user_id", "job").alias("job_id"), F.lit("T").alias("task_id"),
        F.concat_ws("/", "job", "p").alias("key"), F.lit("r").alias("request"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED").alias("state"), F.col("event_type").alias("reason"), F.lit(None).cast("long").alias("expected_revision"),
    )


_JOURNAL = """j as (select user_id, event_id, event_type t, row_number() over (partition by user_id order by ts, event_id) - 1 p from events),
k as (select user_id, event_id, p, t, p // 8 job, case when p % 8 = 0 then 'SUBMITTED' when p % 8 = 1 or t = 'view' then 'QUEUED' when t = 'click' then 'CANCEL_REQUESTED' when t = 'error' then 'FAILED' else 'SUCCEEDED' end s from j)"""


@query(
    f"""with {_JOURNAL}, e as (select *, s in ('FAILED', 'SUCCEEDED') fin from k)
select user_id as ledger_id, user_id || '-' || job as job_id, arg_max(s, p) as state, count(*) revision,
  max(p) filter (fin) is not null as ended, arg_max(t, p) filter (fin) terminal_reason from e group by 1, 2"""
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.states(_journal(spark, sf_dir))
    return out.select("ledger_id", "job_id", "state", "revision", F.col("terminal_event_id").isNotNull().alias("ended"), "terminal_reason")


@query(
    f"""with {_JOURNAL}, b as (select *, lag(s) over (partition by user_id, job order by p) b from k),
v as (select user_id, p, case when p % 8 = 0 then null when s = 'QUEUED' and b <> 'SUBMITTED' then 'queued from another state'
  when s = 'CANCEL_REQUESTED' and b in ('FAILED', 'SUCCEEDED') then 'cancel after the end' when s in ('FAILED', 'SUCCEEDED') and b in ('FAILED', 'SUCCEEDED') then 'ended twice'
  when s in ('FAILED', 'SUCCEEDED') and b = 'CANCEL_REQUESTED' then 'cancelled job ended otherwise' end r from b)
select r as rule, count(*) n from v where r is not null group by 1"""
)
def job_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.broken_rules(_journal(spark, sf_dir)).where("rule <> 'epoch'").groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """with e as (select user_id w, event_type t, row_number() over (partition by user_id order by ts, event_id) q from events),
a as (select w, min(q) q from e where t = 'view' group by 1), b as (select e.w, min(e.q) q from e join a on a.w = e.w and e.q > a.q where t = 'click' group by 1),
c as (select e.w, min(e.q) q from e join b on b.w = e.w and e.q > b.q where t = 'purchase' group by 1)
select u.w as working_id, a.q first_left, b.q second_left, c.q third_left, case when c.q is not null then 'COMPLETED' else 'ACTIVE' end status
from (select distinct w from e) u left join a using (w) left join b using (w) left join c using (w)"""
)
def workflow_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.lit("L").alias("ledger_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("sequence"), F.col("user_id").alias("working_id"), F.col("event_type").alias("type"), *(F.lit(None).cast("string").alias(c) for c in ("kind", "phase", "status")))
    runs = rows.select("ledger_id", "working_id").distinct().withColumn("rite_id", F.lit("R"))
    stages = spark.createDataFrame([("R", i, t, None, None, None) for i, t in enumerate(("view", "click", "purchase"))], "rite_id string, stage_no int, event_type string, kind string, phase string, status string")
    out = workflow.progress(rows, runs, stages)
    at = lambda i: F.get("left_at", F.lit(i))
    return out.select("working_id", at(0).alias("first_left"), at(1).alias("second_left"), at(2).alias("third_left"), "status")


@query(
    """with c as (select c_custkey k, count(o_orderkey) n, count(*) filter (o_orderstatus = 'O') o, count(*) filter (o_orderstatus = 'F') f,
  string_agg(o_orderkey, ', ' order by o_orderkey::varchar) filter (o_orderpriority = '1-URGENT' and o_orderstatus = 'P') u, count(*) filter (o_orderpriority = '2-HIGH') b,
  count(*) filter (o_orderpriority = '3-MEDIUM') a, count(*) filter (o_orderpriority = '5-LOW') d from customer left join orders on o_custkey = c_custkey group by 1)
select k, case when k % 29 = 0 then 'create or select a program' when k % 23 = 0 then 'select an existing program' when u is not null then 'resolve critical issues: ' || u
 when n = 0 then 'record evidence' when k % 2 = 0 then 'seal the question' when o = 0 then 'draft a protocol' when o > 5 then 'seal the protocol' when f = 0 then 'start an experiment'
 when b = 0 then 'record runs and analyse' when a = 0 then 'assess the result' when d = 0 then 'decide' else 'continue from open issues and the last decision' end next_action from c"""
)
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    n = lambda c: F.count_if(F.expr(c))
    urgent = F.when(F.expr("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'"), F.col("o_orderkey").cast("string"))
    counts = joined.groupBy(F.col("c_custkey").alias("k")).agg(
        n("o_orderkey is not null").alias("evidence"), n("o_orderstatus = 'O'").alias("protocols"), n("o_orderstatus = 'F'").alias("experiments"), F.collect_list(urgent).alias("open_critical"),
        n("o_orderpriority = '2-HIGH'").alias("bundles"), n("o_orderpriority = '3-MEDIUM'").alias("assessments"), n("o_orderpriority = '5-LOW'").alias("decisions"),
    )
    rows = counts.select("*", F.when(F.col("k") % 29 != 0, F.col("k")).alias("program_id"), (F.col("k") % 23 != 0).alias("known"), (F.col("k") % 2 != 0).alias("has_question"), F.when(F.col("protocols") > 5, 1).otherwise(0).alias("draft_protocols"))
    return workflow.next_actions(rows).select("k", "next_action")


@query(
    """with b as (select user_id, event_id from events), u as (select distinct user_id from b),
l as (select user_id, count(*) n from b where event_id % 97 = 0 group by 1),
d as (select user_id, count(*) filter (event_id % 97 = 0) + count(*) filter (event_id % 89 = 0) n from b group by 1),
r as (select user_id, 'links' as "check", coalesce(n, 0) n from u left join l using (user_id) union all select user_id, 'digests', coalesce(n, 0) from u left join d using (user_id)),
a as (select * from r union all select user_id, 'all', sum(n) from r group by 1)
select user_id as ledger_id, "check", n::bigint n, case when n = 0 then 'PASS' else 'FAIL' end as result from a"""
)
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tampered(spark, sf_dir)
    return reads.health(rows, {"links": chain.broken_links(rows), "digests": chain.wrong_digests(rows, views.body())})


def _study_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger per nation: a customer is a program, an open order evidence, a pending one a run, a finished one an assessment."""
    from tallyfold.plans.views import table as t

    customers, orders = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    json = lambda *c: F.to_json(F.struct(*c))
    program = F.concat(F.lit("RP-"), F.col("c_custkey").cast("string"))
    made = customers.select(F.col("c_nationkey").cast("string").alias("ledger_id"), F.col("c_custkey").alias("sequence"), F.lit("program.created").alias("type"), program.alias("object_id"), json(F.lower("c_mktsegment").alias("slug"), F.col("c_name").alias("title")).alias("payload"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    kind = F.create_map(F.lit("O"), F.lit("evidence.recorded"), F.lit("P"), F.lit("run.recorded"), F.lit("F"), F.lit("assessment.recorded"))[F.col("o_orderstatus")]
    # every 40th order names a program that doesn't exist, every 60th has the id of the order before it
    of = F.when(F.col("o_orderkey") % 40 == 0, F.lit("RP-none")).otherwise(program)
    own = F.concat(F.lit("X-"), F.when(F.col("o_orderkey") % 60 == 7, F.col("c_custkey") * 0 - 1).otherwise(F.col("o_orderkey")).cast("string"))
    later = rows.select(F.col("c_nationkey").cast("string").alias("ledger_id"), (F.col("o_orderkey") + 10_000_000).alias("sequence"), kind.alias("type"), own.alias("object_id"), json(of.alias("program_id"), F.lit("FORMAL").alias("phase"), F.col("o_orderpriority").alias("source"), F.lit("seen").alias("observation")).alias("payload"))
    both = made.unionByName(later)
    return both.select("*", F.concat(F.lit("CE-"), F.col("sequence").cast("string")).alias("event_id"), F.lit("t").alias("occurred_at"))


@query(
    """with r as (select c_custkey k, max(case o_orderstatus when 'F' then 3 when 'P' then 2 when 'O' then 1 else 0 end) filter (o_orderkey is null or o_orderkey % 40 <> 0) r
from customer left join orders on o_custkey = c_custkey group by 1),
n as (select c_nationkey::varchar ledger_id, 'RP-none' program_id, max(case o_orderstatus when 'F' then 3 when 'P' then 2 else 1 end) r from customer join orders on o_custkey = c_custkey where o_orderkey % 40 = 0 group by 1),
a as (select c_nationkey::varchar ledger_id, 'RP-' || k program_id, coalesce(r, 0) r from r join customer on c_custkey = k union all select * from n)
select ledger_id, program_id, case r when 3 then 'EVALUATED' when 2 then 'RUNNING' when 1 then 'EVIDENCE_RECORDED' else 'IDEA' end status from a"""
)
def program_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furthest state of every program of the study ledgers."""
    from tallyfold.operators import state

    return state.program_status(_study_log(spark, sf_dir))


@query(
    """with o as (select c_nationkey::varchar l, o_orderkey k, o_orderstatus s, row_number() over (partition by c_nationkey, o_orderstatus order by o_orderkey) n from customer join orders on o_custkey = c_custkey where o_orderkey % 60 = 7)
select l as ledger_id, k + 10000000 as sequence, 'duplicate id' as rule from o where n > 1
union all select c_nationkey::varchar, o_orderkey + 10000000, 'unknown reference' from customer join orders on o_custkey = c_custkey where o_orderkey % 40 = 0
union all select l, k, 'duplicate slug' from (select c_nationkey::varchar l, c_custkey k, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) n from customer) where n > 1"""
)
def state_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks a rule across objects in the study ledgers."""
    from tallyfold.operators import state

    return state.audit(_study_log(spark, sf_dir)).select("ledger_id", "sequence", "rule")


@query(
    """with o as (select o_orderkey, o_orderstatus s, o_totalprice p, o_orderpriority y, o_orderdate d from orders),
v as (select o_orderkey, 'o_orderstatus: not one of its values' r, s not in ('O', 'F') b from o union all select o_orderkey, 'o_totalprice: out of bounds', p < 1000 or p > 400000 from o
union all select o_orderkey, 'o_orderpriority: pattern', not regexp_matches(y, '^[1-3]-') from o union all select o_orderkey, 'finished: urgent', s = 'F' and y <> '1-URGENT' from o
union all select o_orderkey, 'o_orderpriority: too short', length(y) < 6 from o)
select o_orderkey, r as rule from v where b"""
)
def record_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table over orders, evaluated in one pass."""
    from tallyfold.operators import contracts as k

    table_ = [k.one_of("o_orderstatus", ["O", "F"]), k.between("o_totalprice", 1000, 400000), k.pattern("o_orderpriority", "^[1-3]-"), k.filled("o_orderpriority", 6), k.implies("finished: urgent", F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT")]
    return k.breaches(table(spark, sf_dir, "orders"), table_, ["o_orderkey"])


@query("select event_id, 'sha256:' || sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') as digest from events")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content digests of canonical JSON."""
    from tallyfold.functions.digest import json_digest

    return table(spark, sf_dir, "events").select("event_id", json_digest(F.col("props")).alias("digest"))


@query(
    """with v as (select user_id, count(*) filter (event_type = 'purchase' and event_id % 3 <> 0) t, count(*) filter (event_type = 'error' and event_id % 3 <> 1) c from events group by 1)
select user_id as seed, (t > 1 or c > 1 or t = 0 or c = 0) faulty from v where t + c > 0"""
)
def pair_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds at which treatment and control don't meet one to one."""
    rows = table(spark, sf_dir, "events")
    t, c = "event_type = 'purchase' and event_id % 3 <> 0", "event_type = 'error' and event_id % 3 <> 1"
    values = rows.select(F.lit("L").alias("ledger_id"), F.lit("P").alias("protocol_id"), F.lit("c").alias("comparison_id"), F.expr(f"case when {t} then 't' when {c} then 'c' end").alias("side"), F.col("event_id").cast("string").alias("run_id"), F.col("user_id").alias("seed"), "value").where("side is not null")
    return compare.pairs(values).select("seed", "faulty")


@query(
    """with n as (select c_custkey k, p from customer, (values ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) v(p))
select k::varchar as experiment_id, p as need from n where not exists (select 1 from orders where o_custkey = k and o_orderpriority = p)"""
)
def pilot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required arms that no recorded pilot run has."""
    key = F.col("c_custkey").cast("string").alias("experiment_id")
    experiments = table(spark, sf_dir, "customer").select(F.lit("L").alias("ledger_id"), key)
    required = experiments.withColumn("need", F.explode(F.array(*(F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")))))
    recorded = table(spark, sf_dir, "orders").select(F.lit("L").alias("ledger_id"), F.col("o_custkey").cast("string").alias("experiment_id"), F.col("o_orderpriority").alias("need"))
    return rules.pilot_gaps(experiments, required, recorded).select("experiment_id", "need")


@query("select o_custkey, case when count(*) = 1 then min(o_orderkey) end o_orderkey, count(*) n from orders where o_orderstatus = 'P' group by 1")
def sole_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one pending order of a customer, or how many there are."""
    return rules.sole_active(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), ["o_custkey"], "o_orderkey")


@query(
    """with f as (select l_orderkey q, l_linenumber i, l_partkey id, l_returnflag s from lineitem)
select p_partkey as id, coalesce(arg_max(s, (q, i, s)), 'PROPOSED') status from part left join f on f.id = p_partkey group by 1"""
)
def last_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the status of the last finding on each."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit("L").alias("ledger_id"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("sequence"), F.struct("l_linenumber", "l_returnflag").alias("position"), F.col("l_returnflag").alias("status"))
    objects = table(spark, sf_dir, "part").select(F.lit("L").alias("ledger_id"), F.col("p_partkey").alias("id"), F.lit("PROPOSED").alias("status"))
    return rules.last_findings(rows, objects).select("id", "status")
