"""Named queries over the driver's tables, each with the SQL that must give the same rows.

Facts come from events (user, event type, k, hour) and from orders (customer, return flag, part, day). Events before hour 504
are the training split, before 612 validation, the rest test. A small rule set over events is mined by hand below.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.functions import rules as R
from tempograph.operators import candidates as C
from tempograph.operators import cleaning as U
from tempograph.operators import confidence as A
from tempograph.operators import diagnostics as D
from tempograph.operators import expansion as X
from tempograph.operators import generation as L
from tempograph.operators import governance as G
from tempograph.operators import graph as N
from tempograph.operators import profile as P
from tempograph.operators import ranking as K
from tempograph.operators import retrieval as M
from tempograph.operators import sampling as S
from tempograph.operators import selection as V
from tempograph.operators import similar as B
from tempograph.operators import walks as J
from tempograph.sources import quads as Q
from tempograph.sources.store import kept

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

VALID_FROM, TEST_FROM, ENTITIES = 504, 612, 100
RELATIONS = ("click", "error", "purchase", "signup", "view")
#: rule_id, head, body, groups of equal positions
RULES = (
    ("r1", "purchase", ["click"], []),
    ("r2", "purchase", ["view"], []),
    ("r3", "purchase", ["view", "inv_click", "click"], []),
    ("r4", "view", ["click"], []),
    ("r5", "purchase", ["signup", "inv_signup", "purchase"], [[0, 2]]),
    ("r6", "error", ["error"], []),
    ("r7", "purchase", ["purchase"], []),
    ("r8", "view", ["view", "inv_view", "error"], [[0, 2], [1, 3]]),
)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(r, h, b, c, i, 0.0) for i, (r, h, b, c) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_id string, head_rel string, body_rels array<string>, var_constraints array<array<int>>, rule_order long, llm_confidence double")


def event_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quads of the events, for plans that read them many times: parsed once and then read."""
    return kept(spark, ("quads", sf_dir), lambda: Q.quads_events(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.split_by_time(event_quads(spark, sf_dir), VALID_FROM, TEST_FROM)


def inverse_name(rel="rel"):
    return F.concat(F.lit("inv_"), F.col(rel))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training facts and their inverses."""
    return Q.with_inverses(Q.background(events(spark, sf_dir), "train"), inverse_name())


def rules_with_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule set with its measures: mined once from the training facts and then read, as a rule file would be."""
    return kept(spark, ("rules", sf_dir), lambda: A.confidences(rule_table(spark), train(spark, sf_dir), distinct=True))


def test_queries(spark: SparkSession, sf_dir: str, split: str = "test") -> DataFrame:
    qid = (F.col("ts") * 1000 + F.col("obj")) * 1_000_000 + F.col("sub")
    return Q.background(events(spark, sf_dir), split).where("rel = 'purchase'").withColumn("qid", qid).select("qid", "sub", "rel", "obj", "ts")


def all_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = J.small(C.with_rule_order(rules_with_confidence(spark, sf_dir)))
    q = test_queries(spark, sf_dir)
    return C.scored(C.shared_evidence(rules, train(spark, sf_dir), q), rules, q)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded to 9 digits as decimals and then to 6, so a value on a tie goes the same way whatever order it was computed in."""
    return df.withColumns({c: F.round(F.col(c).cast("decimal(20,9)"), 6).cast("double") for c in columns})


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept for the plans that use it more than once; equal plans of a session share it."""
    return rounded(C.aggregated(all_evidence(spark, sf_dir)), "score", digits=9).persist(StorageLevel.DISK_ONLY)


def answers(q: DataFrame) -> DataFrame:
    return q.select("qid", F.col("obj").alias("entity"))


# ---- SQL of the same

ORDERS = "quads as (select distinct o_custkey as sub, ascii(l_returnflag)::bigint as rel, 10000000 + l_partkey as obj, date_diff('day', timestamp '1992-01-01', l_shipdate)::bigint as ts from lineitem join orders on l_orderkey = o_orderkey)"
EVENTS = "quads as (select distinct user_id as sub, event_type as rel, regexp_extract(props, '\"k\": ?([0-9]+)', 1)::bigint as obj, date_diff('hour', timestamp '2024-01-01', ts)::bigint as ts from events)"
TRAIN = f"{EVENTS}, base as (select * from quads where ts < {VALID_FROM}), facts as (select sub, rel, obj, ts from base union all select obj, 'inv_' || rel, sub, ts from base)"


def _body(rule, extra: str = "", exact: bool = True, tables: str = "facts", more: str = "") -> str:
    rid, head, body, groups = rule
    n = len(body)
    es = [f"a{i}.sub" for i in range(n)] + [f"a{n - 1}.obj"]
    joins = f"{tables} a0" + "".join(f" join {tables} a{i} on a{i}.sub = a{i - 1}.obj and a{i}.ts >= a{i - 1}.ts" for i in range(1, n))
    tests = [f"a{i}.rel = '{r}'" for i, r in enumerate(body)]
    same = {(a, b) for g in groups for a in g for b in g if a < b}
    for a in range(n + 1):
        for b in range(a + 1, n + 1):
            if (a, b) in same:
                tests.append(f"{es[a]} = {es[b]}")
            elif groups and exact:
                tests.append(f"{es[a]} <> {es[b]}")
    return f"select '{rid}' as rule_id, '{head}' as head_rel, {es[0]} as e0, {es[n]} as ek, a0.ts as t0, a{n - 1}.ts as t_last{extra} from {joins}{more} where {' and '.join(tests)}"


_BODIES = " union all ".join(_body(r) for r in RULES)
_RULE_ROWS = ", ".join(f"('{r}', '{h}', {i}, {len(b)})" for i, (r, h, b, _) in enumerate(RULES))
CONF = f"""{TRAIN}, rule_rows(rule_id, head_rel, rule_order, len) as (values {_RULE_ROWS}),
bodies as ({_BODIES}), heads as (select rel, sub, obj, max(ts) as m from facts group by all),
counts as (select b.rule_id, count(*) as body_supp, count(*) filter (h.m > b.t_last) as rule_supp from bodies b left join heads h on h.rel = b.head_rel and h.sub = b.e0 and h.obj = b.ek group by 1),
rules as (select r.rule_id, r.head_rel, r.rule_order, r.len, coalesce(body_supp, 0)::bigint as body_supp, coalesce(rule_supp, 0)::bigint as rule_supp,
  coalesce(round(rule_supp / nullif(body_supp, 0), 6), 0.0)::double as conf from rule_rows r left join counts using (rule_id)),
ordered as (select *, row_number() over (partition by head_rel order by conf desc, rule_order) - 1 as rule_idx from rules)"""
TESTQ = f"testq as (select (ts * 1000 + obj) * 1000000 + sub as qid, sub, rel, obj, ts from quads where rel = 'purchase' and ts >= {TEST_FROM})"
_EVIDENCE = " union all ".join(_body(r, ", q.qid as qid", False, more=" join testq q on q.sub = a0.sub") for r in RULES if r[1] == "purchase")
FOUND = f"{CONF}, {TESTQ}, walks as ({_EVIDENCE}), ev as (select qid, rule_id, ek as entity, max(t0) as t0, max(t_last) as t_last from walks group by all)"
SCORED = f"{FOUND}, sc as (select ev.qid, ev.rule_id, o.rule_idx, ev.entity, 0.5 * o.conf + 0.5 * exp(0.1 * (ev.t0 - q.ts)) as score from ev join ordered o using (rule_id) join testq q using (qid))"
CANDS = f"{SCORED}, cands as (select qid, entity, round(1 - product(1 - score), 9) as score from sc group by all)"
OTHERS = "others as (select distinct q.qid, o.obj as entity from testq q join testq o on q.sub = o.sub and q.ts = o.ts and q.obj <> o.obj), kept as (select * from cands c where not exists (select 1 from others x where x.qid = c.qid and x.entity = c.entity))"
RANKED = f"""{CANDS}, {OTHERS}, own as (select q.qid, k.score as own from testq q left join kept k on k.qid = q.qid and k.entity = q.obj),
ranked as (select o.qid, case when max(own) is null then {ENTITIES} else count(*) filter (k.score > own) + 1 end as best,
  case when max(own) is null then {ENTITIES} else (2 * count(*) filter (k.score > own) + count(*) filter (k.score = own) + 1) // 2 end as average,
  case when max(own) is null then {ENTITIES} else count(*) filter (k.score > own) + count(*) filter (k.score = own) end as worst,
  case when max(own) is not null then count(*) filter (k.score > own) + 1 end as cand_rank from own o left join kept k using (qid) group by o.qid)"""


# ---- sources


@query(f"with {ORDERS} select sub, rel, obj, ts from quads union all select obj, rel + 1000, sub, ts from quads")
def s_inverse_quads(spark, sf_dir):
    return Q.with_inverses(Q.quads_orders(spark, sf_dir), F.col("rel") + Q.INVERSE_OFFSET)


@query("select user_id, date, (dense_rank() over (order by date) - 1)::bigint as ts from (select distinct user_id, strftime(ts, '%Y-%m-%d') as date from events)")
def s_ts_vocab(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date")).distinct()
    return rows.join(F.broadcast(Q.timestamp_vocabulary(rows, "date")), "date").select("user_id", "date", "ts")  # one row per day


@query(f"with {EVENTS} select case when ts < {VALID_FROM} then 'train' when ts < {TEST_FROM} then 'valid' else 'test' end as split, rel, count(*) as n from quads where ts < {VALID_FROM} or ts >= {TEST_FROM} group by all")
def s_background_split(spark, sf_dir):
    return Q.background(events(spark, sf_dir), "train_test").groupBy("split", "rel").agg(F.count(F.lit(1)).alias("n"))


@query("select n1.n_nationkey::bigint as id, n1.n_name as name, n1.n_nationkey::bigint + c.n as inv_id, false as is_inverse from nation n1, (select count(*) as n from nation) c union all select n1.n_nationkey + c.n, 'inv_' || n1.n_name, n1.n_nationkey, true from nation n1, (select count(*) as n from nation) c")
def s_relation_vocabulary(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    return Q.relations_with_inverses(names)


@query("select o_orderkey as key, o_custkey as sub, p.rnk as obj from orders join (select o_orderpriority as name, dense_rank() over (order by o_orderpriority) - 1 as rnk from (select distinct o_orderpriority from orders)) p on p.name = o_orderpriority")
def s_encode(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    vocabulary = Q.timestamp_vocabulary(orders, "o_orderpriority").select(F.col("date").alias("name"), F.col("ts").alias("id"))
    numbers = orders.select(F.col("o_custkey").cast("string").alias("name"), F.col("o_custkey").alias("id")).distinct()
    times = orders.select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").alias("id")).distinct()
    named = orders.select(F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderpriority").alias("relation"), F.col("o_custkey").cast("string").alias("object"), F.col("o_orderkey").cast("string").alias("timestamp"))
    return Q.encode(named, numbers, vocabulary, times).select(F.col("ts").alias("key"), "sub", F.col("rel").alias("obj"))


# ---- walks and windows


@query(f"with {ORDERS} select rel, sub, obj, max(ts) as max_ts from quads group by all")
def a2_pair_max_ts(spark, sf_dir):
    return A.pair_max_ts(Q.quads_orders(spark, sf_dir))


_TWO = "facts as (select * from quads union all select obj, rel + 1000, sub, ts from quads)"


@query(f"with {ORDERS} select a.sub as e0, a.ts as t0, a.obj as e1, b.ts as t1, b.sub as e2 from quads a join quads b on a.obj = b.obj and a.sub = b.sub and b.ts >= a.ts where a.rel = 78 and b.rel = 82")
def j3_walk_2hop(spark, sf_dir):
    facts = Q.with_inverses(Q.quads_orders(spark, sf_dir), F.col("rel") + Q.INVERSE_OFFSET)
    return J.chain(facts, [78, 1082], constraints=[[0, 2]])


@query(f"with {ORDERS}, {_TWO} select count(*) as walks, max(c.ts) as last from facts a join facts b on b.sub = a.obj and b.ts >= a.ts join facts c on c.sub = b.obj and c.ts >= b.ts where a.rel = 65 and b.rel = 1078 and c.rel = 65")
def j3_walk_3hop_count(spark, sf_dir):
    facts = Q.with_inverses(Q.quads_orders(spark, sf_dir), F.col("rel") + Q.INVERSE_OFFSET)
    return J.chain(facts, [65, 1078, 65]).agg(F.count(F.lit(1)).alias("walks"), F.max("t2").alias("last"))


@query(f"with {ORDERS}, {_TWO} select count(*)::bigint as walks, max(c.ts) as last from facts a join facts b on b.sub = a.obj and b.ts >= a.ts join facts c on c.sub = b.obj and c.ts >= b.ts where a.rel = 65 and b.rel = 1078 and c.rel = 65")
def j3_eager_counts(spark, sf_dir):
    facts = Q.with_inverses(Q.quads_orders(spark, sf_dir), F.col("rel") + Q.INVERSE_OFFSET)
    return J.eager_counts(facts, [65, 1078, 65]).agg(F.sum("bodies").alias("walks"), F.max("t_last").alias("last"))


@query(f"with {TRAIN} select a.sub as e0, b.obj as e2, max(a.ts) as t0, max(b.ts) as t_last, count(*) as walks from facts a join facts b on b.sub = a.obj where a.rel = 'click' and b.rel = 'inv_view' group by all")
def j4_relaxed_walks(spark, sf_dir):
    walks = J.chain(train(spark, sf_dir), ["click", "inv_view"], relax=True)
    return walks.groupBy("e0", "e2").agg(F.max("t0").alias("t0"), F.max("t1").alias("t_last"), F.count(F.lit(1)).alias("walks"))


@query(f"with {EVENTS}, times as (select distinct ts as query_ts from quads where rel = 'purchase' and ts >= {TEST_FROM}) select query_ts, rel, count(*) as n, min(ts) as low, max(ts) as high from times join quads on ts < query_ts and ts >= query_ts - 24 group by all")
def f2_window_edges(spark, sf_dir):
    found = J.window_edges(Q.quads_events(spark, sf_dir), test_queries(spark, sf_dir), 24)
    return found.groupBy("query_ts", "rel").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))


@query(f"with {EVENTS}, {TESTQ} select q.qid, e.sub, e.rel, e.obj, e.ts from quads e join testq q on e.sub = q.sub and e.obj = q.obj and e.ts < q.ts")
def f3_pair_window(spark, sf_dir):
    return J.pair_window_edges(Q.quads_events(spark, sf_dir), test_queries(spark, sf_dir), 0)


@query(f"with {TRAIN} select a.sub as e0, a.obj as e1, c.obj as e3, count(*) as n from facts a join facts b on b.sub = a.obj and b.ts >= a.ts join facts c on c.sub = b.obj and c.ts >= b.ts where a.rel = 'signup' and b.rel = 'inv_signup' and c.rel = 'view' and a.sub = b.obj and a.obj = c.obj group by all")
def f6_var_constraints(spark, sf_dir):
    walks = J.chain(train(spark, sf_dir), ["signup", "inv_signup", "view"], constraints=[[0, 2], [1, 3]])
    return walks.groupBy("e0", "e1", "e3").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {EVENTS} select sub, rel, obj, ts from quads where ts between 100 and 199")
def f5_time_mask(spark, sf_dir):
    return Q.between_times(Q.quads_events(spark, sf_dir), 100, 199)


@query(f"with {EVENTS}, {TESTQ} select qid, sub from testq where sub not in (select sub from quads where ts < 5 union select obj from quads where ts < 5)")
def f12_unseen(spark, sf_dir):
    return X.unseen(test_queries(spark, sf_dir), Q.quads_events(spark, sf_dir).where("ts < 5")).select("qid", "sub")


# ---- confidence and application


@query(f"with {CONF} select rule_id, body_supp, rule_supp, conf from rules")
def a1_rule_confidence(spark, sf_dir):
    return A.confidences(rule_table(spark), train(spark, sf_dir), distinct=True).select("rule_id", "body_supp", "rule_supp", "conf")


@query(f"with {CONF} select rule_id, conf, rule_idx from ordered where conf >= 0.01 and body_supp >= 2 and len in (1, 3)")
def f1_usable_rules(spark, sf_dir):
    rules = C.with_rule_order(rules_with_confidence(spark, sf_dir))
    return C.usable(rules, lengths=[1, 3]).select("rule_id", "conf", "rule_idx")


@query(f"with {FOUND} select qid, rule_id, entity, t0, t_last from ev")
def a3_evidence(spark, sf_dir):
    return C.evidence(rules_with_confidence(spark, sf_dir), train(spark, sf_dir), test_queries(spark, sf_dir))


@query(f"with {SCORED} select qid, rule_id, entity, round(score, 6) as score from sc")
def a3_candidate_scores(spark, sf_dir):
    return rounded(all_evidence(spark, sf_dir).select("qid", "rule_id", "entity", "score"), "score")


@query(f"with {FOUND} select ev.qid, rule_id, entity, round(0.3 * conf + 0.7 * exp(0.05 * (t_last - q.ts)) + 0.1 * 0.5, 6) as score from ev join ordered using (rule_id) join testq q using (qid)")
def x16_end_scores(spark, sf_dir):
    rules, q = C.with_rule_order(rules_with_confidence(spark, sf_dir)), test_queries(spark, sf_dir)
    found = C.evidence(rules, train(spark, sf_dir), q)
    return rounded(C.scored(found, rules, q, "end", a=0.3, rate=0.05, corr=0.5, corr_weight=0.1).select("qid", "rule_id", "entity", "score"), "score")


def _aggregate(kind: str, sql: str):
    def run(spark, sf_dir):
        return settled(C.aggregated(all_evidence(spark, sf_dir), kind), "score")

    run.__name__ = "a4_" + kind.replace("-", "_")
    return query(f"with {SCORED} select qid, entity, round(({sql})::decimal(20,9), 6)::double as score from sc group by all")(run)


for _kind, _sql in (("noisy-or", "1 - product(1 - score)"), ("sum", "sum(score::decimal(20,9))"), ("mean", "sum(score::decimal(20,9))::double / count(*)"), ("min", "min(score)"), ("max", "max(score)")):
    _aggregate(_kind, _sql)


@query(f"with {SCORED}, stop as (select qid, min(rule_idx) filter (rule_idx >= 2) as stop from sc group by qid) select qid, entity, rule_id from sc join stop using (qid) where rule_idx < 2 or rule_idx = stop")
def t4_rule_priority(spark, sf_dir):
    return C.rule_priority(all_evidence(spark, sf_dir), 2).select("qid", "entity", "rule_id")


@query()
def t3_early_stop(spark, sf_dir):
    return rounded(C.aggregated(C.early_stop(all_evidence(spark, sf_dir), 5)), "score")


@query(f"with {CANDS}, t as (select *, row_number() over (partition by qid order by score desc, entity) as place from cands) select qid, entity, round(score, 6) as score, place from t where place <= 10")
def r1_apply_rules_top10(spark, sf_dir):
    return rounded(C.top_k(candidate_scores(spark, sf_dir), 10), "score")


@query(f"with {SCORED}, d as (select qid, entity, rule_id, round(0.9 * score * coalesce((select product(1 - o.score) from sc o where o.qid = sc.qid and o.entity = sc.entity and o.rule_id <> sc.rule_id), 1), 6) as delta from sc) select * from d")
def a5_rule_delta(spark, sf_dir):
    return rounded(C.deltas(all_evidence(spark, sf_dir)), "delta")


# ---- ranks


@query(f"with {CANDS}, {OTHERS} select qid, entity, score from kept")
def f8_filtered(spark, sf_dir):
    return K.filtered(candidate_scores(spark, sf_dir), test_queries(spark, sf_dir))


def _ranks(spark, sf_dir) -> DataFrame:
    q = test_queries(spark, sf_dir)
    return K.ranks(K.filtered(candidate_scores(spark, sf_dir), q), answers(q), ENTITIES)


@query(f"with {RANKED} select qid, best, average, worst, cand_rank from ranked")
def w1_filtered_rank(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(f"with {RANKED} select count(*) as queries, round(avg((best <= 1)::int), 6) as hits1, round(avg((best <= 3)::int), 6) as hits3, round(avg((best <= 10)::int), 6) as hits10, round(avg(1.0 / best), 6) as mrr from ranked")
def a6_hits_mrr(spark, sf_dir):
    return K.hits_and_mrr(_ranks(spark, sf_dir), "best")


#: A baseline by frequency: how often each object was bought in training, over the most bought one's count.
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = Q.background(events(spark, sf_dir), "train").where("rel = 'purchase'")
    counts = base.groupBy(F.col("obj").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    scores = counts.crossJoin(F.broadcast(top)).select("entity", F.round(F.col("n") / F.col("top"), 9).alias("score"))
    return test_queries(spark, sf_dir).select("qid").join(F.broadcast(scores), F.lit(True))  # one row per object of a fixed set


BASELINE = "counts2 as (select obj as entity, count(*) as n from base where rel = 'purchase' group by 1), graph as (select qid, entity, round(n / (select max(n) from counts2), 9) as g from testq, counts2)"
GRID = f"""{CANDS}, {BASELINE}, weights as (select i / 20.0 as w from range(21) t(i)),
both_ as (select qid, entity, coalesce(c.score, 0) as r, coalesce(g, 0) as g from cands c full join graph using (qid, entity)),
others as (select distinct q.qid, o.obj as entity from testq q join testq o on q.sub = o.sub and q.ts = o.ts and q.obj <> o.obj),
fused as (select qid, w::double as w, entity, round(g + w::double * (r - g), 9) as score from (select * from both_ b where not exists (select 1 from others x where x.qid = b.qid and x.entity = b.entity)), weights),
own as (select qid, w, max(score) filter (entity = obj) as own from fused join testq using (qid) group by all),
grid as (select qid, w, count(*) filter (score > coalesce(own, 0)) + 1 as rank from fused join own using (qid, w) group by all)"""


def fused_scores(spark: SparkSession, sf_dir: str, weights: tuple[float, ...] = K.WEIGHTS) -> DataFrame:
    q = test_queries(spark, sf_dir)
    others = K.other_answers(q)
    rule = candidate_scores(spark, sf_dir).join(others, ["qid", "entity"], "left_anti")
    graph = baseline(spark, sf_dir).join(others, ["qid", "entity"], "left_anti")
    return rounded(K.fused(rule, graph, weights), "score", digits=9)


@query(f"with {GRID} select w, count(*) as queries, round(avg((rank <= 1)::int), 6) as hits1, round(avg((rank <= 3)::int), 6) as hits3, round(avg((rank <= 10)::int), 6) as hits10, round(avg(1.0 / rank), 6) as mrr from grid group by w")
def a6_hits_mrr_grid(spark, sf_dir):
    ranked = K.rank_grid(fused_scores(spark, sf_dir), answers(test_queries(spark, sf_dir)))
    return K.hits_and_mrr(ranked, "rank", ["w"])


@query(f"with {GRID}, t as (select w, round(avg(1.0 / rank), 6) as mrr from grid group by w) select w, mrr from t order by abs(w - 0.33), w limit 1")
def t14_nearest_weight(spark, sf_dir):
    ranked = K.rank_grid(fused_scores(spark, sf_dir), answers(test_queries(spark, sf_dir)))
    return K.nearest_weight(K.hits_and_mrr(ranked, "rank", ["w"]).select("w", "mrr"), 0.33)


TRACE = f"""{GRID}, top as (select qid, arg_max(entity, (score, -entity)) as pred_top1 from fused where w = 0.9 group by 1), gtop as (select qid, arg_max(entity, (score, -entity)) as graph_top1 from fused where w = 0.0 group by 1),
size as (select qid, count(*) as cand_size from cands group by 1), gt as (select q.qid, count(*) filter (c.score > o.score) + 1 as gt_rank from testq q join cands o on o.qid = q.qid and o.entity = q.obj join cands c on c.qid = q.qid group by 1),
trace as (select q.qid, case when q.sub % 2 = 0 then 'even' else 'odd' end as relation, q.obj as gt_tail, coalesce(pred_top1, -1) as pred_top1, coalesce(graph_top1, -1) as graph_top1, coalesce(cand_size, 0) as cand_size, gt_rank
  from testq q left join top using (qid) left join gtop using (qid) left join size using (qid) left join gt using (qid))"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace row per query; users stand in for relations, as only one relation is asked."""
    q, cands = test_queries(spark, sf_dir), candidate_scores(spark, sf_dir)
    top = K.predicted_by(fused_scores(spark, sf_dir, (0.0, 0.9)), {"pred_top1": 0.9, "graph_top1": 0.0})
    size = cands.groupBy("qid").agg(F.count(F.lit(1)).alias("cand_size"))
    gt = K.ranks(cands, answers(q), ENTITIES).select("qid", F.col("cand_rank").alias("gt_rank"))
    rows = q.select("qid", F.when(F.col("sub") % 2 == 0, "even").otherwise("odd").alias("relation"), F.col("obj").alias("gt_tail"))
    out = rows.join(top, "qid", "left").join(size, "qid", "left").join(gt, "qid", "left")
    return out.fillna(-1, ["pred_top1", "graph_top1"]).fillna(0, ["cand_size"])


@query(f"with {TRACE} select * from trace")
def r3_trace(spark, sf_dir):
    return trace(spark, sf_dir)


_BUCKET = "case when cand_size = 0 then 'NoCand' when pred_top1 = gt_tail then 'HitTop1' when gt_rank is null then 'NoHit' else 'HitNotTop1' end"


@query(f"with {TRACE} select {_BUCKET} as bucket, count(*) as n, round(count(*) / (select count(*) from trace), 6) as share, round(avg(gt_rank), 6) as mean_rank, round(quantile_cont(gt_rank, 0.5), 6) as median_rank, round(quantile_cont(gt_rank, 0.95), 6) as p95_rank from trace group by 1")
def a7_breakdown(spark, sf_dir):
    return D.breakdown(trace(spark, sf_dir))


@query(f"with {TRACE} select case when graph_top1 = gt_tail and pred_top1 <> gt_tail then 'harm' when graph_top1 <> gt_tail and pred_top1 = gt_tail then 'improve' else 'same' end as effect, count(*) as n from trace group by 1")
def a7_harm_improve(spark, sf_dir):
    return D.harm_and_improve(trace(spark, sf_dir))


_DIAG = "diag as (select relation, count(*) as n, count(*) - count(gt_rank) as nohit, count(gt_rank) as hit, count(*) filter (pred_top1 = gt_tail) as top1, round(count(*) filter (pred_top1 = gt_tail) / nullif(count(gt_rank), 0), 6) as cond_top1_given_hit, count(*) filter (pred_top1 <> gt_tail) as wrong_top1, round(quantile_cont(cand_size, 0.95), 6) as cand_size_p95, round(avg(gt_rank), 6) as mean_rank from trace group by 1)"


@query(f"with {TRACE}, {_DIAG} select * from diag where n >= 2")
def a8_relation_diagnosis(spark, sf_dir):
    return D.relation_diagnosis(trace(spark, sf_dir), 2)


@query(f"with {TRACE}, {_DIAG} select * from diag order by nohit + wrong_top1 desc, n desc, relation limit 1")
def t7_worst_relations(spark, sf_dir):
    return D.worst_relations(D.relation_diagnosis(trace(spark, sf_dir)), 1)


@query(f"""with {TRACE}, w as (select relation, pred_top1 as eid, count(*) as wrong, min(qid) as f from trace where pred_top1 <> gt_tail group by all), w2 as (select *, row_number() over (partition by relation order by wrong desc, f) as p from w),
p as (select case when sub % 2 = 0 then 'even' else 'odd' end as relation, obj as eid, count(*) as n from base where rel = 'purchase' group by all), p2 as (select *, row_number() over (partition by relation order by n desc, eid) as train_rank from p)
select relation, count(*) as wrong_items, count(train_rank) as overlap, sum(wrong)::bigint as wrong, round(count(train_rank) / count(*), 6) as overlap_share from (select * from w2 where p <= 10) left join (select relation, eid, train_rank from p2 where train_rank <= 10) using (relation, eid) group by 1""")
def a9_popularity_bias(spark, sf_dir):
    base = Q.background(events(spark, sf_dir), "train").where("rel = 'purchase'")
    side = base.withColumn("rel", F.when(F.col("sub") % 2 == 0, "even").otherwise("odd"))
    return D.popularity_bias(trace(spark, sf_dir), side)


def rule_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace with the rules behind the predicted and the true answer."""
    t, found = trace(spark, sf_dir), all_evidence(spark, sf_dir)

    def of(column: str, name: str) -> DataFrame:
        hit = found.join(t.select("qid", F.col(column).alias("entity")), ["qid", "entity"])
        return hit.groupBy("qid").agg(F.sort_array(F.collect_set("rule_id")).alias(name))

    out = t.join(of("pred_top1", "top1_rules"), "qid", "left").join(of("gt_tail", "ans_rules"), "qid", "left")
    empty = F.array(F.lit("GRAPH"))
    return out.withColumn("top1_rules", F.coalesce("top1_rules", empty)).withColumn("ans_rules", F.coalesce("ans_rules", empty))


@query(f"""with {TRACE}, t1 as (select distinct t.qid, s.rule_id, pred_top1 = gt_tail as ok, gt_rank from trace t join sc s on s.qid = t.qid and s.entity = t.pred_top1), a1 as (select distinct t.qid, s.rule_id from trace t join sc s on s.qid = t.qid and s.entity = t.gt_tail where pred_top1 = gt_tail),
x as (select rule_id, count(*) as trigger, count(*) filter (not ok) as wrong, round(avg(gt_rank), 6) as avg_gt_rank from t1 group by 1), y as (select rule_id, count(*) as help from a1 group by 1)
select rule_id, coalesce(trigger, 0) as trigger, coalesce(wrong, 0) as wrong, avg_gt_rank, coalesce(help, 0) as help, coalesce(round(wrong / nullif(trigger, 0), 6), 0) as harm_rate from x full join y using (rule_id)""")
def a11_harmful_rules(spark, sf_dir):
    return D.harmful_rules(rule_trace(spark, sf_dir))


@query(f"with {CONF}, r as (select rule_id, head_rel, conf * (1 + 1 / sqrt(rule_supp + 1)) * (1 + 0.1 * greatest(0, len - 1)) as risk from rules), o as (select *, row_number() over (partition by head_rel order by risk desc, rule_id) as place from r) select rule_id, head_rel, round(risk, 6) as risk, place from o where place <= 2")
def a12_risk(spark, sf_dir):
    return D.risky_rules(rules_with_confidence(spark, sf_dir), 2).select("rule_id", "head_rel", "risk", "place")


@query(f"with {TRACE}, o as (select qid, relation, (pred_top1 <> gt_tail)::int as is_error, row_number() over (partition by relation order by (pred_top1 <> gt_tail)::int desc, qid) as place from trace) select * from o where place <= 20")
def t9_cases(spark, sf_dir):
    return D.sample_cases(trace(spark, sf_dir), 20).select("qid", "relation", "is_error", "place")


# ---- governance

_PATCH = (("delete", 0, "r4", None), ("downweight", 0, "r1", 0.1), ("downweight", 1, "r4", 0.5), ("downweight", 2, "unknown", 0.5), ("downweight", 3, "r7", 0.5), ("promote", 0, "r2", 1.5), ("promote", 1, "r7", 1.1))
_PATCH_ROWS = ", ".join(f"('{a}', {p}, '{r}', {'null' if s is None else s}::double)" for a, p, r, s in _PATCH)
PATCH = f"""{CONF}, patch(action, pos, rule_id, scale) as (values {_PATCH_ROWS}), known as (select * from patch where rule_id in (select rule_id from rules)),
valid as (select action, pos, rule_id, case action when 'downweight' then least(greatest(scale, 0.2), 0.9) when 'promote' then least(greatest(scale, 1.0), 1.2) end as scale from known where action = 'delete' or rule_id not in (select rule_id from known where action = 'delete'))"""


def patch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_PATCH), "action string, pos int, rule_id string, scale double")


def valid_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.valid_patch(patch(spark), rule_table(spark))


@query(f"with {PATCH} select action, rule_id, scale from valid")
def r6_valid_patch(spark, sf_dir):
    return valid_patch(spark, sf_dir).select("action", "rule_id", "scale")


@query(f"with {PATCH} select rule_id, round(least(greatest(conf * coalesce((select max(scale) from valid v where v.rule_id = r.rule_id and action = 'downweight'), 1) * coalesce((select max(scale) from valid v where v.rule_id = r.rule_id and action = 'promote'), 1), 0), 1), 6) as conf from rules r where rule_id not in (select rule_id from valid where action = 'delete')")
def r7_apply_patch(spark, sf_dir):
    rules = rules_with_confidence(spark, sf_dir)
    return rounded(G.apply_patch(rules, valid_patch(spark, sf_dir)).select("rule_id", "conf"), "conf")


@query(f"with {EVENTS} select (ts * 1000 + obj) * 1000000 + sub as qid, rel from quads where ts >= {TEST_FROM} and rel in ('purchase', 'view')")
def r8_affected_queries(spark, sf_dir):
    qid = (F.col("ts") * 1000 + F.col("obj")) * 1_000_000 + F.col("sub")
    every = Q.background(events(spark, sf_dir), "test").select(qid.alias("qid"), "rel")
    return G.affected_queries(rule_table(spark), valid_patch(spark, sf_dir), every).select("qid", "rel")


@query(f"with {CANDS} select qid, entity, score from cands where qid % 2 = 1 union all select qid, entity, score * 0.5 from cands where qid % 2 = 0")
def u9_overlay(spark, sf_dir):
    old = candidate_scores(spark, sf_dir)
    return G.overlay(old, old.where("qid % 2 = 0").withColumn("score", F.col("score") * 0.5))


# ---- profiles


@query(f"""with {EVENTS}, p as (select rel, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, max(ts) - min(ts) as span, count(*) / (max(ts) - min(ts) + 1) as d from quads group by 1), c as (select quantile_cont(d, 1.0 / 3) as a, quantile_cont(d, 0.5) as m, quantile_cont(d, 2.0 / 3) as b from p)
select rel, n, first_ts, last_ts, span, round(d, 6) as density, round(m, 6) as median_density, case when d <= a then 'LOW' when d <= b then 'MEDIUM' else 'HIGH' end as level from p, c""")
def a14_profile(spark, sf_dir):
    return P.relation_profile(Q.quads_events(spark, sf_dir))


_PAIRS = "pairs as (select o_orderpriority as rel, c_mktsegment as source, o_orderstatus as target, count(*) as n from orders join customer on o_custkey = c_custkey group by all), ranked as (select *, round(n / sum(n) over (partition by rel), 6) as share, row_number() over (partition by rel order by n desc, source, target) as place from pairs)"


@query(f"with {_PAIRS} select rel, source, target, n, share, place from ranked where place <= 3")
def a15_pair_shares(spark, sf_dir):
    orders, customers = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("rel"), F.col("c_mktsegment").alias("source"), F.col("o_orderstatus").alias("target"))
    return P.pair_shares(rows, k=3)


@query("with r as (select *, row_number() over (partition by o_custkey order by case when o_orderstatus <> 'F' then 0 else 1 end, case when o_orderstatus <> 'F' then -o_orderkey else o_orderkey end) as p from orders) select o_custkey, o_orderkey from r where p = 1")
def s16_prefer_complete(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("source", F.when(F.col("o_orderstatus") != "F", "x")).withColumn("target", F.lit("y"))
    return P.prefer_complete(orders, ["o_custkey"], "o_orderkey", "source", "target").select("o_custkey", "o_orderkey")


@query()
def p7_reservoir(spark, sf_dir):
    return P.reservoir(Q.quads_events(spark, sf_dir), "rel", 20, ["sub", "obj", "ts"])


@query()
def p5_sampled_confidence(spark, sf_dir):
    return A.sampled_confidences(rule_table(spark), train(spark, sf_dir))


@query()
def p6_edges_by_time(spark, sf_dir):
    return S.edges_by_time(Q.quads_events(spark, sf_dir), "rel")


@query()
def p4_walks(spark, sf_dir):
    facts = train(spark, sf_dir)
    names = [(r, f"inv_{r}") for r in RELATIONS] + [(f"inv_{r}", r) for r in RELATIONS]
    return S.sample_walks(facts, spark.createDataFrame(names, "rel string, inv string"))


@query()
def g9_rules_from_walks(spark, sf_dir):
    names = spark.createDataFrame([(r, f"inv_{r}") for r in RELATIONS] + [(f"inv_{r}", r) for r in RELATIONS], "rel string, inv string")
    return N.rules_from_walks(S.sample_walks(train(spark, sf_dir), names), names)


# ---- retrieval

_WORDS = "tok as (select doc_id as doc, unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) as token from documents)"
TFIDF = f"""{_WORDS}, tf as (select doc, token, count(*) as tf from tok group by all), n as (select count(distinct doc) as n from tok), idf as (select token, ln((n + 1) / (count(*) + 1)) + 1 as idf from tf, n group by token, n),
w as (select doc, token, tf, idf, tf * idf as weight from tf join idf using (token)), norms as (select doc, sqrt(sum(weight * weight)) as norm from w group by 1)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("doc"), F.explode(F.split(F.lower("text"), " ")).alias("token")).where("token <> ''")


@query(f"with {TFIDF} select doc, count(*) as terms, sum(tf)::bigint as words, round(max(idf), 6) as top_idf, round(max(norm), 6) as norm from w join norms using (doc) group by doc")
def a16_tfidf(spark, sf_dir):
    return M.tfidf(tokens(spark, sf_dir)).groupBy("doc").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("words"), F.round(F.max("idf"), 6).alias("top_idf"), F.round(F.max("norm"), 6).alias("norm"))


def _similar(spark, sf_dir) -> DataFrame:
    index = M.tfidf(tokens(spark, sf_dir))
    q = tokens(spark, sf_dir).where("doc % 50 = 0").select(F.col("doc").alias("query"), "token")
    sims = M.cosine(M.query_vectors(q, index), index)
    return rounded(sims.where("query <> doc"), "sim", digits=9)


_SIMS = f"{TFIDF}, sims as (select a.doc as query, b.doc, round(sum(a.weight * b.weight) / (any_value(na.norm) * any_value(nb.norm)), 9) as sim from w a join w b on a.token = b.token and a.doc % 50 = 0 and a.doc <> b.doc join norms na on na.doc = a.doc join norms nb on nb.doc = b.doc group by all)"


@query(f"with {_SIMS}, o as (select query, doc, sim, row_number() over (partition by query order by sim desc, doc) as place from sims) select query, doc, round(sim, 6) as sim, place from o where place <= 5")
def m1_topk_cosine(spark, sf_dir):
    return rounded(B.top_cosine(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.expr("doc_id % 50 = 0"), 5), "sim")


@query()
def m2_mmr(spark, sf_dir):
    index = M.tfidf(tokens(spark, sf_dir))
    return M.diverse(M.most_similar(_similar(spark, sf_dir), 20), index, 3, 0.7)


_CHUNK = "ch as (select c_nationkey as head, c_name as path, row_number() over (partition by c_nationkey order by c_acctbal desc, c_name) - 1 as p from customer), s as (select head, p // 2 as chunk, list(path order by p) as paths from ch where p < 40 group by all)"


@query(f"with {_CHUNK}, rl as (select s_nationkey as head, s_name as rule, row_number() over (partition by s_nationkey order by s_acctbal desc, s_name) - 1 as p from supplier), t as (select head, p // 2 as chunk, list(rule order by p) as rules from rl where p < 30 group by all) select head, chunk::bigint as chunk, array_to_string(paths, ';') as paths, array_to_string(rules, ';') as rules from s join t using (head, chunk) where len(paths) = 2 and len(rules) = 2 and chunk < 5")
def t10_pool_chunks(spark, sf_dir):
    paths = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("head"), F.col("c_name").alias("path"), F.col("c_acctbal").alias("conf"))
    rules = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("head"), F.col("s_name").alias("rule"), F.col("s_acctbal").alias("conf"))
    return M.pool_chunks(paths, rules, chunk=2).select("head", "chunk", F.array_join("paths", ";").alias("paths"), F.array_join("rules", ";").alias("rules"))


@query("with c as (select c_nationkey, count(*) as n from customer group by 1) select round(avg(n), 6) as mean, round(median(n), 6) as median, min(n) as min, max(n) as max from c")
def a17_pool_statistics(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return M.pool_statistics(counts, "n")


@query("with q as (select vec_id as id, embedding::double[] as e from embeddings), s as (select a.id as query, b.id as doc, round(list_cosine_similarity(a.e, b.e), 6) as sim, row_number() over (partition by a.id order by list_cosine_similarity(a.e, b.e) desc, b.id) as place from q a join q b on a.id % 50 = 0 and a.id <> b.id) select * from s where place <= 5")
def t6_similar_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return rounded(M.dense_cosine(vectors.where("id % 50 = 0"), vectors, 5), "sim")


# ---- expansion (candidates of the test queries)

RECENT = "rec as (select q.qid, e.obj as entity, 1.0 / (any_value(q.ts) - max(e.ts)) as r from testq q join quads e on e.ts < q.ts and e.ts >= q.ts - 24 group by q.qid, e.obj)"


@query(f"with {EVENTS}, {TESTQ}, {RECENT} select qid, entity, round(r, 6) as score from rec")
def a20_recency(spark, sf_dir):
    return rounded(X.recency(event_quads(spark, sf_dir), test_queries(spark, sf_dir), 24), "score")


@query(f"""with {EVENTS}, {TESTQ}, {RECENT}, nb as (select q.qid, case when e.sub = q.sub then e.obj end as a, case when e.obj = q.sub then e.sub end as b from testq q join quads e on e.ts < q.ts and e.ts >= q.ts - 24 and (e.sub = q.sub or e.obj = q.sub)), ends as (select qid, a as entity from nb where a is not null union all select qid, b from nb where b is not null),
cnt as (select qid, entity, count(*)::double as score from ends group by all) select qid, entity, score from cnt union all select qid, entity, round(r, 6) from rec where qid not in (select qid from cnt)""")
def c2_neighbour_counts(spark, sf_dir):
    return rounded(X.neighbour_counts(event_quads(spark, sf_dir), test_queries(spark, sf_dir), 24), "score")


@query(f"""with {CANDS}, bounds as (select qid, min(score) as a, max(score) as b from cands group by 1), nw as (select q.qid, e.obj as entity, max(e.ts) as last from testq q join bounds using (qid) join quads e on e.ts >= q.ts - 24 group by all),
l as (select n.*, ln(last / sum(last) over (partition by n.qid)) as l from (select * from nw n where not exists (select 1 from cands c where c.qid = n.qid and c.entity = n.entity)) n), m as (select *, min(l) over (partition by qid) as lo, max(l) over (partition by qid) as hi from l)
select qid, entity, round(score, 6) as score from cands union all select qid, entity, round(0.2 * (a + (b - a) * (l - lo) / (hi - lo)), 6) from m join bounds using (qid) where lo < hi""")
def c3_expanded(spark, sf_dir):
    return rounded(X.expanded(candidate_scores(spark, sf_dir), test_queries(spark, sf_dir), event_quads(spark, sf_dir), 24), "score")


@query(f"with {CANDS}, {RECENT}, ratio as (select qid, min(score / r) as ratio from cands join rec using (qid, entity) group by 1) select qid, entity, round(coalesce(c.score, x.r), 6) as score from cands c full join (select qid, entity, r * coalesce(ratio, 1) as r from rec left join ratio using (qid)) x using (qid, entity)")
def c4_expanded_by_ratio(spark, sf_dir):
    return rounded(X.expanded_by_ratio(candidate_scores(spark, sf_dir), test_queries(spark, sf_dir), event_quads(spark, sf_dir), 24), "score")


@query(f"""with {CANDS}, stats as (select q.qid, any_value(q.sub) as sub, any_value(q.ts) as ts, count(c.entity) as n, coalesce(min(score), 0) as a, coalesce(max(score), 1) as b from testq q left join cands c using (qid) group by 1),
near as (select s.qid, e.obj as entity, any_value(a) as a, any_value(b) as b, 1.0 / (any_value(s.ts) - max(e.ts)) as x from stats s join quads e on e.ts < s.ts and e.ts >= s.ts - 24 and (e.sub = s.sub or e.obj = s.sub) where n <> 1 group by s.qid, e.obj),
sc2 as (select qid, entity, a, b, x, min(x) over (partition by qid) as lo, max(x) over (partition by qid) as hi from near), r as (select qid, entity, case when hi = lo then a else a + (x - lo) * (b - a) / (hi - lo) end as r from sc2), have as (select distinct qid from r),
bare as (select s.qid, e.obj as entity, 1.0 / (any_value(s.ts) - max(e.ts)) as score from stats s join quads e on e.ts < s.ts where n = 0 and s.qid not in (select qid from have) group by s.qid, e.obj)
select qid, entity, round((0.6 * coalesce(r.r, 0) + 0.4 * coalesce(c.score, 0))::decimal(20,9), 6)::double as score from r full join (select * from cands where qid in (select qid from have)) c using (qid, entity) union all select qid, entity, round(score::decimal(20,9), 6)::double from cands where qid not in (select qid from have) union all select qid, entity, round(score::decimal(20,9), 6)::double from bare""")
def c5_expanded_by_frequency(spark, sf_dir):
    return settled(X.expanded_by_frequency(candidate_scores(spark, sf_dir), test_queries(spark, sf_dir), event_quads(spark, sf_dir), 24, 0.4), "score")


@query(f"with {CANDS}, {RECENT}, sh as (select distinct qid from cands join rec using (qid, entity)) select qid, entity, round(case when qid in (select qid from sh) then coalesce(c.score, 0) + coalesce(rec.r, 0) else rec.r end, 6) as score from cands c full join rec using (qid, entity) where qid in (select qid from sh) or rec.r is not null")
def c6_expanded_by_sum(spark, sf_dir):
    return rounded(X.expanded_by_sum(candidate_scores(spark, sf_dir), test_queries(spark, sf_dir), event_quads(spark, sf_dir), 24), "score")


_NEAR = "nb as (select q.qid, q.ts as qts, e.ts, unnest(list_filter([case when e.sub = q.sub then e.obj end, case when e.obj = q.sub then e.sub end], lambda x: x is not null)) as entity from testq q join quads e on e.ts < q.ts and e.ts >= q.ts - 24 and (e.sub = q.sub or e.obj = q.sub)), near as (select qid, entity, 0.5 / (any_value(qts) - max(ts)) as r from nb group by qid, entity), nw as (select * from near union all select * from rec where qid not in (select qid from near))"


@query(f"with {CANDS}, {RECENT}, {_NEAR} select qid, entity, round(coalesce(c.score, nw.r), 6) as score from cands c full join nw using (qid, entity)")
def c7_expanded_by_source(spark, sf_dir):
    return rounded(X.expanded_by_neighbours(candidate_scores(spark, sf_dir), test_queries(spark, sf_dir), event_quads(spark, sf_dir), 24, 0.5)[0], "score")


@query(f"with {CANDS}, {RECENT}, {_NEAR} select qid, qid in (select qid from cands) as has_candidates, qid in (select qid from near) as has_neighbours, exists (select 1 from near n where n.qid = q.qid and n.entity = q.obj) as answer_among from testq q")
def c7_source_flags(spark, sf_dir):
    return X.expanded_by_neighbours(candidate_scores(spark, sf_dir), test_queries(spark, sf_dir), event_quads(spark, sf_dir), 24, 0.5)[1]


@query(f"with {CANDS}, {RECENT}, nb as (select q.qid, q.ts as qts, e.ts, unnest([e.sub, e.obj]) as entity from testq q join quads e on e.ts < q.ts and e.ts >= q.ts - 24 and e.rel = q.rel), near as (select qid, entity, 0.5 / (any_value(qts) - max(ts)) as r from nb group by qid, entity), nw as (select * from near union all select * from rec where qid not in (select qid from near)) select qid, entity, round(coalesce(c.score, nw.r), 6) as score from cands c full join nw using (qid, entity)")
def c7_expanded_by_relation(spark, sf_dir):
    return rounded(X.expanded_by_neighbours(candidate_scores(spark, sf_dir), test_queries(spark, sf_dir), event_quads(spark, sf_dir), 24, 0.5, "relation")[0], "score")


@query(f"with {CANDS}, {RECENT}, a as (select qid, entity, (score - min(score) over w) / case when max(score) over w = min(score) over w then 1 else max(score) over w - min(score) over w end as a from cands window w as (partition by qid)), b as (select qid, entity, (r - min(r) over w) / case when max(r) over w = min(r) over w then 1 else max(r) over w - min(r) over w end as b from rec window w as (partition by qid)) select qid, entity, round(case when a is not null and b is not null then a + 0.3 * b else coalesce(a, 0.3 * b) end, 6) as score from a full join b using (qid, entity)")
def c8_merged(spark, sf_dir):
    q = test_queries(spark, sf_dir)
    return rounded(X.merged(candidate_scores(spark, sf_dir), X.recency(event_quads(spark, sf_dir), q, 24), 0.3), "score")


@query(f"with {CANDS} select c.qid, c.entity, round(c.score, 6) as score from cands c join testq q using (qid) join (select obj, max(ts) as last from base group by 1) b on b.obj = c.entity where last >= q.ts - 120")
def f13_recently_seen(spark, sf_dir):
    base = Q.background(events(spark, sf_dir), "train")
    return rounded(X.recently_seen(candidate_scores(spark, sf_dir), test_queries(spark, sf_dir), base, 120), "score")


# ---- static graph (parts and suppliers); searches ask for every supplier whose id is divisible by 50, among all rows


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(supplier, return flag, part) with the part beyond 10,000,000, and the order as the place."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_suppkey").alias("head"), F.col("l_returnflag").alias("rel"), (F.col("l_partkey") + 10_000_000).alias("tail"), F.col("l_orderkey").alias("pos")).distinct()


TRIPLES = "tri as (select distinct l_suppkey as head, l_returnflag as rel, l_partkey + 10000000 as tail, l_orderkey as pos from lineitem)"
EDGES = f"{TRIPLES}, e as (select distinct head, rel, tail from tri union select tail, 'inv_' || rel, head from tri)"


def static_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    t = lines.select(F.col("l_suppkey").alias("head"), F.col("l_returnflag").alias("rel"), (F.col("l_partkey") + 10_000_000).alias("tail")).distinct()
    return t.unionByName(t.select(F.col("tail").alias("head"), inverse_name().alias("rel"), F.col("head").alias("tail")))


@query(f"with {TRIPLES} select least(head, tail) as a, greatest(head, tail) as b, arg_max(rel, (pos, rel)) as rel from (select head, tail, max(rel) as rel, pos from tri group by all) group by 1, 2")
def g1_undirected(spark, sf_dir):
    t = triples(spark, sf_dir).groupBy("head", "tail", "pos").agg(F.max("rel").alias("rel"))
    return N.undirected(t)


@query(f"with {TRIPLES}, t as (select head, tail, min(rel) as rel, pos from tri group by all), p as (select distinct head, tail + 1 as tail from tri where head % 50 = 0), f as (select head, tail, arg_min(rel, pos) as rel from t group by 1, 2) select p.head, p.tail, f.rel from p left join f using (head, tail)")
def g4_connected(spark, sf_dir):
    t = triples(spark, sf_dir)
    pairs = t.where("head % 50 = 0").select("head", (F.col("tail") + 1).alias("tail")).distinct()
    return N.connected(t.groupBy("head", "tail", "pos").agg(F.min("rel").alias("rel")), pairs)


@query(f"""with {EDGES}, anchors as (select distinct head, rel, tail from tri where head % 50 = 0), one as (select a.head, a.rel, a.tail, x.rel as path from anchors a join e x on x.head = a.head and x.tail = a.tail and x.rel <> a.rel),
three as (select a.head, a.rel, a.tail, x.rel || '|' || y.rel || '|' || z.rel as path from anchors a join e x on x.head = a.head and x.tail <> a.tail join e y on y.head = x.tail and y.tail not in (a.head, x.tail) and y.tail <> a.tail join e z on z.head = y.tail and z.tail = a.tail)
select distinct * from (select * from one union all select * from three)""")
def g5_closed_paths(spark, sf_dir):
    anchors = triples(spark, sf_dir).where("head % 50 = 0")
    return N.closed_paths_by_blocks(anchors, static_edges(spark, sf_dir), 3).select("head", "rel", "tail", F.array_join("path", "|").alias("path"))


@query(f"with {EDGES}, r as (select distinct head as root from tri where head % 50 = 0), h1 as (select distinct root, e.tail as node from r join e on e.head = root), h2 as (select distinct root, e.tail as node from h1 join e on e.head = node where e.tail <> root and (root, e.tail) not in (select root, node from h1)) select root, node, 1::bigint as hop from h1 union all select root, node, 2 from h2")
def g7_khop(spark, sf_dir):
    t = triples(spark, sf_dir)
    return N.neighbours(t, t.where("head % 50 = 0").select(F.col("head").alias("node")).distinct(), 2)


@query(f"with {TRIPLES}, n as (select 1::bigint as node union select 2 union (select tail from tri where head = 1 intersect select tail from tri where head = 2)) select distinct head, tail from tri where head in (select node from n) and tail in (select node from n)")
def g8_enclosing(spark, sf_dir):
    return N.enclosing(triples(spark, sf_dir), 1, 2)


@query(f"with {EDGES}, p as (select a.head, c.tail, count(*) * 0.5 as s from e a join e b on b.head = a.tail join e c on c.head = b.tail where a.rel = 'R' and b.rel = 'inv_A' and c.rel = 'N' group by all union all select head, tail, 0.25 from e where rel = 'A') select head, tail, sum(s)::double as score from p group by all")
def j16_path_counts(spark, sf_dir):
    return N.path_counts(static_edges(spark, sf_dir), [(["R", "inv_A", "N"], 0.5), (["A"], 0.25)], distinct=True)


# ---- rule strings

_STRINGS = ("make_a_visit(X0,X2,T2) <- meet(X0,X1,T0) & Return,_release_person(s)(X1,X2,T1)", "A (X0, X1, T1)<-B(X0, X1, T0)", "Host(X0,X0,T3)<-a(X0,X1,T0)&b(X1,X2,T1)&c(X2,X0,T2)")
_STRING_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(_STRINGS))


def rule_strings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_STRINGS)), "id int, rule string")


# the normal forms, written out by hand
_NORMAL = ("make_a_visit(X0,X2,T2) <- meet(X0,X1,T0)&Return,_release_person(s)(X1,X2,T1)", "A (X0, X1, T1) <- B(X0, X1, T0)", "Host(X0,X0,T3) <- a(X0,X1,T0)&b(X1,X2,T1)&c(X2,X0,T2)")


@query("select id, substr(sha1(rule), 1, 12) as rule_id, atoms::int as atoms from (values " + ", ".join(f"({i}, '{s}', {s.count('&') + 1})" for i, s in enumerate(_NORMAL)) + ") t(id, rule, atoms)")
def x1_rule_id(spark, sf_dir):
    return rule_strings(spark).select("id", R.rule_id(F.col("rule")).alias("rule_id"), R.body_length(F.col("rule")).alias("atoms"))


@query("select * from (values (0, 'make_a_visit', 'meet;Return,_release_person(s)', ''), (1, 'A', 'B', ''), (2, 'Host', 'a;b;c', '0,3')) t(id, head, body, groups)")
def x4_parsed_rules(spark, sf_dir):
    groups = F.array_join(F.transform("var_constraints", lambda g: F.array_join(F.transform(g, lambda p: p.cast("string")), ",")), ";")
    return R.parsed(rule_strings(spark)).select("id", "head", F.array_join("body", ";").alias("body"), groups.alias("groups"))


@query(f"with {CONF} select rule_id, printf('%8.6f  %4d  %4d  ', conf, rule_supp, body_supp) || text as line from rules join (values "
       + ", ".join(f"('{r}', '{t}')" for r, t in (("r1", "purchase(X0,X1,T1)<-click(X0,X1,T0)"), ("r3", "purchase(X0,X3,T3)<-view(X0,X1,T0)&inv_click(X1,X2,T1)&click(X2,X3,T2)"), ("r5", "purchase(X0,X2,T3)<-signup(X0,X1,T0)&inv_signup(X1,X0,T1)&purchase(X0,X2,T2)")))
       + ") t(rule_id, text) using (rule_id)")
def x2_verbalised(spark, sf_dir):
    rules = rules_with_confidence(spark, sf_dir).where("rule_id in ('r1', 'r3', 'r5')")
    return rules.select("rule_id", R.verbalised(R.canonical("head_rel", "body_rels", arrow="<-")).alias("line"))


@query(r"select p_partkey as id, trim(regexp_replace(lower(regexp_replace(regexp_replace(p_type, '([A-Z])', ' \1', 'g'), '^ ', '')), '^$', '')) as name from (select p_partkey, case when contains(p_type, '/') or contains(p_type, '_') or contains(p_type, '&') then null else p_type end as p_type from part)")
def x11_clean_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), R.clean_name(F.col("p_type")).alias("name"))


_NAMES = (("_hypernym_", "hypernym"), ("member_of_domain", "member of domain"), ("isA&partOf", "isA partOf"), ("wasBornIn", "was born in"), ("/people/person", "born as"), ("inverse /people/person", "inverse born as"), ("a/b_c", "a/b_c"), ("ABC", "a b c"), ("_in_A", "in A"))


@query("select * from (values " + ", ".join(f"({i}, '{b}')" for i, (_, b) in enumerate(_NAMES)) + ") t(id, name)")
def x11_clean_name_forms(spark, sf_dir):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_NAMES)], "id int, raw string")
    return rows.select("id", R.clean_name(F.col("raw"), {"/people/person": "born as"}).alias("name"))


_TIED = ((0, ["b", "c", "d"], [[0, 2]], "h(X0,X2,T3) <- b(X0,X1,T0)&c(X1,X0,T1)&d(X0,X2,T2)"), (1, ["b", "c", "d"], [[1, 3]], "h(X0,X1,T3) <- b(X0,X1,T0)&c(X1,X2,T1)&d(X2,X1,T2)"), (2, ["b"], [], "h(X0,X1,T1) <- b(X0,X1,T0)"), (3, ["b", "c", "d"], [[1, 3], [2, 0]], "h(X0,X1,T3) <- b(X0,X1,T0)&c(X1,X0,T1)&d(X0,X1,T2)"))


@query("select id, rule, substr(sha1(rule), 1, 12) as rule_id from (values " + ", ".join(f"({i}, '{t}')" for i, _, _, t in _TIED) + ") t(id, rule)")
def x2_canonical(spark, sf_dir):
    rows = spark.createDataFrame([(i, "h", b, g) for i, b, g, _ in _TIED], "id int, head string, body array<string>, var_constraints array<array<int>>")
    return rows.withColumn("rule", R.canonical()).select("id", "rule", R.rule_id(F.col("rule")).alias("rule_id"))


@query("select * from (values (0::bigint), (1), (3)) t(rule_order)")
def u3_distinct_rules(spark, sf_dir):
    rows = [(0, "h", ["b", "c"], [[0, 2]]), (1, "h", ["b", "c"], []), (2, "h", ["b", "c"], [[1], [2, 0]]), (3, "h", ["c", "b"], []), (4, "h", ["b", "c"], [[0], [1], [2]])]
    rules = spark.createDataFrame(rows, "rule_order long, head_rel string, body_rels array<string>, var_constraints array<array<int>>")
    return U.distinct_rules(rules).select("rule_order")


@query(f"with {CONF} select len::bigint as length, count(*) as rules, count(distinct head_rel) as relations from rules group by 1")
def a18_rule_lengths(spark, sf_dir):
    return U.length_counts(rules_with_confidence(spark, sf_dir))


@query(f"with {CONF} select rule_id, case when conf > 0.05 then 'high' else 'low' end as side from rules")
def f7_split_by_confidence(spark, sf_dir):
    return U.split_by_confidence(rules_with_confidence(spark, sf_dir), 0.05).select("rule_id", "side")


_LINES = ("purchase(X0,X1,T1)<-click(X0,X1,T0)", "purchse(X0,X1,T1) <- clik(X0,X1,T0)", "purchase(X0,X2,T2)<-click(X0,X1,T0)&view(X2,X1,T1)", "purchase(X0,X2,T2)<-click(X0,X1,T1)&view(X1,X2,T0)", "no rule at all", "zzzz(X0,X1,T1)<-click(X0,X1,T0)", "purchase(X0,X1,Tx)<-click(X0,X1,T0)", "purchase(X0,X1,T1)<-click(X0,X1,T0)")


@query("select * from (values (0, 'purchase(X0,X1,T1)<-click(X0,X1,T0)', null), (1, 'purchase(X0,X1,T1)<-click(X0,X1,T0)', null), (2, null, 'no chain'), (3, null, 'time order'), (4, null, 'no atom'), (5, null, 'unknown relation'), (6, null, 'time is no number'), (7, 'purchase(X0,X1,T1)<-click(X0,X1,T0)', null)) t(id, clean, error)")
def u1_clean(spark, sf_dir):
    lines = spark.createDataFrame(list(enumerate(_LINES)), "id int, rule string")
    return U.clean_rules(lines, list(RELATIONS)).select("id", "clean", "error")


@query("select 0 as id, 'purchase(X0,X1,T1)<-click(X0,X1,T0)' as clean")
def u2_first_occurrences(spark, sf_dir):
    lines = spark.createDataFrame(list(enumerate(_LINES)), "id int, rule string")
    return U.first_occurrences(U.clean_rules(lines, list(RELATIONS)).where("clean is not null"), "clean", "id").select("id", "clean")


@query(f"with {EVENTS} select distinct rel as head, rel || '(X0,X1,T1)<-' || p || '(X0,X1,T0)' as rule from quads, (values ('click'), ('view')) t(p)")
def l_generated_rules(spark, sf_dir):
    heads = Q.quads_events(spark, sf_dir).select(F.col("rel").alias("head")).distinct()
    paths = heads.withColumn("p", F.explode(F.array(F.lit("click"), F.lit("view")))).withColumn("path", F.concat("head", F.lit("(X0,X1,T1)<-"), "p", F.lit("(X0,X1,T0)")))
    return L.generated(paths.withColumn("conf", F.lit(1.0)), L.PathEcho)


@query("with r as (select c_nationkey, c_custkey, sum(length(c_name)) over (partition by c_nationkey order by c_custkey rows unbounded preceding) as total from customer) select c_nationkey, c_custkey from r where total <= 100")
def x31_within_length(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return R.within_length(rows, "c_nationkey", "c_custkey", "c_name", 100).select("c_nationkey", "c_custkey")


# ---- subsets, lookups and frontiers

QUADS2 = f"{ORDERS}, both_ways as (select sub, rel, obj, ts from quads union all select obj, rel + 1000, sub, ts from quads)"


def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_inverses(Q.quads_orders(spark, sf_dir), F.col("rel") + Q.INVERSE_OFFSET)


@query(f"with {QUADS2} select rel, count(*) as n from both_ways where rel < 1000 group by 1")
def f9_forward_queries(spark, sf_dir):
    return V.forward(both_ways(spark, sf_dir), Q.INVERSE_OFFSET).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {EVENTS}, {TESTQ} select * from testq where sub % 50 = 0")
def f10_qid_subset(spark, sf_dir):
    q = test_queries(spark, sf_dir)
    return V.of_qids(q, q.where("sub % 50 = 0"))


@query(f"with {QUADS2}, r as (select rel % 1000 as base_rel, ts % 13 + 1 as rank from both_ways where rel % 1000 in (65, 82)) select base_rel, count(*) as queries, round(avg((rank <= 1)::int), 6) as hits1, round(avg((rank <= 3)::int), 6) as hits3, round(avg((rank <= 10)::int), 6) as hits10, round(avg(1.0 / rank), 6) as mrr from r group by 1")
def f11_folded_metrics(spark, sf_dir):
    chosen = spark.createDataFrame([(65,), (1082,)], "rel long")
    ranked = V.of_relations(both_ways(spark, sf_dir), chosen, Q.INVERSE_OFFSET).withColumn("rank", F.col("ts") % 13 + 1)
    return K.hits_and_mrr(ranked, "rank", ["base_rel"])


@query(f"with {QUADS2} select sub, rel, obj, ts from both_ways where rel < 1000 and ts % 50 = 0")
def u6_forward_among_requested(spark, sf_dir):
    q = both_ways(spark, sf_dir).withColumn("qid", F.xxhash64("sub", "rel", "obj", "ts"))
    return V.requested(q, q.where("ts % 50 = 0"), Q.INVERSE_OFFSET).drop("qid")


@query(f"with {EVENTS}, {TESTQ}, rows2 as (select user_id as sub, event_type as rel, regexp_extract(props, '\"k\": ?([0-9]+)', 1)::bigint as obj, date_diff('hour', timestamp '2024-01-01', ts)::bigint as ts, arg_min(value, event_id) as s from events where user_id % 3 > 0 group by 1, 2, 3, 4) select qid, coalesce(s, 0) as own, s is not null and s <> 0 as found from testq left join rows2 using (sub, rel, obj, ts)")
def j8_baseline_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 3 > 0")
    hours = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("long")
    rows = e.select(F.col("user_id").alias("sub"), F.col("event_type").alias("rel"), F.get_json_object("props", "$.k").cast("long").alias("obj"), hours.alias("ts"), F.array("value", F.lit(0.0)).alias("scores"), F.col("event_id").alias("pos"))
    found = V.baseline_rows(test_queries(spark, sf_dir), rows, 2, missing="zeros")
    return found.select("qid", F.col("scores")[0].alias("own"), (F.col("scores")[0] != 0).alias("found"))


@query(f"""with {CANDS}, size as (select qid, count(*) as cand_size, arg_max(entity, (score, -entity)) as top from cands group by 1), gt as (select q.qid, count(*) filter (c.score > o.score) + 1 as gt_rank from testq q join cands o on o.qid = q.qid and o.entity = q.obj join cands c on c.qid = q.qid group by 1),
trace as (select q.qid, q.obj as gt_tail, coalesce(top, -1) as pred_top1, coalesce(cand_size, 0) as cand_size, gt_rank from testq q left join size using (qid) left join gt using (qid))
select {_BUCKET} as bucket, count(*) as n, round(count(*) / (select count(*) from trace), 6) as share, round(avg(gt_rank), 6) as mean_rank, round(quantile_cont(gt_rank, 0.5), 6) as median_rank, round(quantile_cont(gt_rank, 0.95), 6) as p95_rank from trace group by 1""")
def a10_breakdown_without_trace(spark, sf_dir):
    return D.breakdown(D.trace_of_candidates(candidate_scores(spark, sf_dir), test_queries(spark, sf_dir)))


@query(f"""with {TRACE}, {_DIAG}, worst as (select * from diag order by nohit + wrong_top1 desc, n desc, relation limit 2), w as (select relation, pred_top1 as eid, count(*) as wrong, min(qid) as f from trace where pred_top1 <> gt_tail group by all), w2 as (select *, row_number() over (partition by relation order by wrong desc, f) as p from w),
p as (select case when sub % 2 = 0 then 'even' else 'odd' end as relation, obj as eid, count(*) as n from base where rel = 'purchase' group by all), p2 as (select *, row_number() over (partition by relation order by n desc, eid) as train_rank from p),
bias as (select relation, round(count(train_rank) / count(*), 6) as overlap_share from (select * from w2 where p <= 10) left join (select relation, eid, train_rank from p2 where train_rank <= 10) using (relation, eid) group by 1)
select relation, n, wrong_top1, overlap_share from worst left join bias using (relation)""")
def j14_worst_with_popularity(spark, sf_dir):
    base = Q.background(events(spark, sf_dir), "train").where("rel = 'purchase'")
    side = base.withColumn("rel", F.when(F.col("sub") % 2 == 0, "even").otherwise("odd"))
    t = trace(spark, sf_dir)
    return D.worst_with_popularity(D.relation_diagnosis(t), D.popularity_bias(t, side), 2).select("relation", "n", "wrong_top1", "overlap_share")


@query("select * from (values ('no chain', 1::bigint), ('time order', 1), ('no atom', 1), ('unknown relation', 1), ('time is no number', 1), ('kept', 1), ('new', 0)) t(outcome, n)")
def a24_cleaning_counts(spark, sf_dir):
    lines = spark.createDataFrame(list(enumerate(_LINES)), "id int, rule string")
    original = spark.createDataFrame([("purchase(X0,X1,T1) <- click(X0,X1,T0)",)], "rule string")
    return U.cleaning_counts(U.clean_rules(lines, list(RELATIONS)), original)


@query("select head, rule, (row_number() over (partition by head order by rule) - 1)::bigint as place from (select c_nationkey as head, c_mktsegment as rule from customer union select s_nationkey, s_name from supplier)")
def u5_final_rules(spark, sf_dir):
    low = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("head"), F.col("c_mktsegment").alias("rule"))
    high = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("head"), F.col("s_name").alias("rule"))
    return V.final_rules(low, high)


@query(f"with {TRAIN}, h0 as (select 0 as hop, * from facts where rel = 'view' and sub in (select sub from base where sub % 50 = 0)), h1 as (select 1 as hop, * from facts where rel = 'inv_click' and sub in (select obj from h0)) select hop, sub, rel, obj, ts from h0 union all select hop, sub, rel, obj, ts from h1")
def j1_frontier(spark, sf_dir):
    facts = train(spark, sf_dir)
    starts = Q.background(events(spark, sf_dir), "train").where("sub % 50 = 0")
    return V.frontier(facts, starts, ["view", "inv_click"])


@query(f"with {TRAIN} select a.rel as r0, b.rel as r1, count(*) as n, max(b.ts) as last from facts a join facts b on b.sub = a.obj and b.ts >= a.ts where a.sub in (select sub from base where sub % 50 = 0) group by all")
def j5_complete_walks(spark, sf_dir):
    starts = Q.background(events(spark, sf_dir), "train").where("sub % 50 = 0")
    return V.complete_walks(train(spark, sf_dir), starts, 2).groupBy("r0", "r1").agg(F.count(F.lit(1)).alias("n"), F.max("t1").alias("last"))


@query("with r as (select o_custkey, o_orderpriority, arg_min(o_orderstatus, o_orderkey) as status from orders where o_orderstatus <> 'O' group by all) select o_orderkey, status from orders left join r using (o_custkey, o_orderpriority)")
def j10_with_rows(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.where("o_orderstatus <> 'O'").select("o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("place_in_file"))
    return V.with_rows(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), rows, ["o_custkey", "o_orderpriority"], "place_in_file").select("o_orderkey", "status")


@query("select n_nationkey as head, n_nationkey in (select c_nationkey from customer where c_acctbal > 9000) as has_paths from nation")
def u7_heads_by_paths(spark, sf_dir):
    heads = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("head"))
    return V.by_paths(heads, spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("head")))


@query(f"with {EVENTS} select a.rel, b.rel as other from quads a join quads b on a.sub = b.sub and a.obj = b.obj and a.ts = b.ts and a.rel <> b.rel union select 'click', 'view'")
def u8_candidate_relations(spark, sf_dir):
    q = Q.quads_events(spark, sf_dir)
    seen = q.join(q.withColumnRenamed("rel", "other"), ["sub", "obj", "ts"]).select("rel", "other")
    return V.candidate_relations(spark.createDataFrame([("click", "view"), ("view", "view")], "rel string, other string"), seen)


@query("select * from (values (0, '2,25,1'), (1, '0'), (2, '3,')) t(id, rels)")
def x6_indexed_paths(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    first = {r["id"]: r["name"] for r in names.where("id < 4").collect()}
    paths = spark.createDataFrame([(0, f"{first[2]}|inv_{first[0]}|{first[1]}"), (1, first[0]), (2, f"{first[3]}|unknown")], "id int, path string")
    found = V.indexed(paths, Q.relations_with_inverses(names).select("name", "id"))
    return found.select("id", F.array_join(F.transform("rels", lambda r: F.coalesce(r.cast("string"), F.lit(""))), ",").alias("rels"))


@query(f"with {TRIPLES} select head, count(distinct tail) as n, sum(distinct tail)::bigint as total from tri group by 1")
def g2_descendants(spark, sf_dir):
    return V.descendants(triples(spark, sf_dir)).select("head", F.size("tails").cast("long").alias("n"), F.aggregate("tails", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
