"""Proofs: filters, joins, aggregates, users and splits (F, J, A, U, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import filters, joins, users
from ..operators.ranking import exact_quantiles, neighbour_top_k, split_train_test, stable_index
from . import frames
from .base import proof
from .lexicon import rounded

CODE = "lpad(CAST({n} AS VARCHAR),2,'0')||lpad(CAST({k}%7 AS VARCHAR),3,'0')||lpad(CAST({k}%11 AS VARCHAR),6,'0')||CAST({k}%2 AS VARCHAR)||lpad(CAST({k}%1000 AS VARCHAR),3,'0')"
GEO_SQL = f"""usr AS (SELECT c_custkey AS uid, c_acctbal, c_mktsegment, {CODE.format(n='c_nationkey', k='c_custkey')} AS code FROM customer),
sp AS (SELECT *, code[1:2] AS state, code[3:5] AS county, code[6:11] AS tract, code[12:12] AS block_group, code[13:15] AS block FROM usr),
geo AS (SELECT state, county, tract, block_group, sum(c_acctbal) AS total_pop, avg(c_acctbal) AS income FROM sp WHERE uid % 3 = 0 GROUP BY ALL)"""


def geo_users(spark, d):
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    code = F.concat(pad(F.col("c_nationkey"), 2), pad(k % 7, 3), pad(k % 11, 6), (k % 2).cast("string"), pad(k % 1000, 3))
    u = frames.table(spark, d, "customer").select(k.alias("uid"), "c_acctbal", "c_mktsegment", code.alias("code"))
    return u.select("*", *[c.alias(n) for n, c in filters.split_block_code(F.col("code")).items()])


def areas(spark, d):
    u = geo_users(spark, d).where("uid % 3 = 0")
    return u.groupBy(*joins.GEO_KEYS).agg(F.sum("c_acctbal").alias("total_pop"), F.avg("c_acctbal").alias("income"))


@proof("block_codes", "F8", "WITH " + GEO_SQL + " SELECT uid, state, county, tract, block_group, block FROM sp")
def block_codes(spark, d):
    return geo_users(spark, d).select("uid", *joins.GEO_KEYS, "block")


@proof("users_with_areas", "J1 F9", "WITH " + GEO_SQL + " SELECT uid, state, county, round(total_pop, 2) AS total_pop, round(income, 4) AS income FROM sp JOIN geo USING (state, county, tract, block_group) WHERE total_pop > 0")
def users_with_areas(spark, d):
    j = filters.filter_positive(joins.join_geo(geo_users(spark, d), areas(spark, d)), "total_pop")
    return j.select("uid", "state", "county", F.round("total_pop", 2).alias("total_pop"), F.round("income", 4).alias("income"))


@proof("user_cells", "F10 A12 J2", """
WITH j AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey),
m AS (SELECT avg(c_acctbal) AS v FROM j)
SELECT CASE WHEN c_acctbal > v AND c_mktsegment='BUILDING' THEN 1 WHEN c_acctbal > v AND c_mktsegment='MACHINERY' THEN 2
  WHEN c_mktsegment='BUILDING' THEN 3 WHEN c_mktsegment='MACHINERY' THEN 4 ELSE 0 END AS cell, count(*) AS n FROM j, m GROUP BY 1""")
def user_cells(spark, d):
    cust = frames.table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), "c_acctbal", "c_mktsegment")
    attr = frames.table(spark, d, "orders").select(F.col("o_custkey").alias("uid")).distinct()
    cells = filters.assign_cells(joins.join_user_attr(cust, attr), "c_acctbal", "c_mktsegment", ("BUILDING", "MACHINERY"))
    return ag.value_counts(cells, "cell")


@proof("renamed_orders", "F7", "SELECT o_orderkey AS uid, CAST(o_custkey AS DOUBLE) AS who, o_totalprice AS price, o_orderstatus AS status FROM orders")
def renamed_orders(spark, d):
    names = {"o_orderkey": "uid", "o_custkey": "who", "o_totalprice": "price", "o_orderstatus": "status"}
    return filters.rename_and_cast(frames.table(spark, d, "orders"), names, ["o_custkey", "o_totalprice"])


@proof("named_customers", "J3 J4", """
SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def named_customers(spark, d):
    c = frames.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"))
    n = frames.table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name", F.col("n_regionkey").alias("regionkey"))
    r = frames.table(spark, d, "region").select(F.col("r_regionkey").alias("regionkey"), "r_name")
    return joins.natural_join(joins.join_identity_names(c, n, "nationkey"), r).select("c_custkey", "n_name", "r_name")


@proof("orders_of_known_users", "J6", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def orders_of_known_users(spark, d):
    known = frames.table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.semi_join(frames.table(spark, d, "orders"), known, "o_custkey").select("o_orderkey", "o_custkey")


@proof("distinct_areas", "A15", "WITH " + GEO_SQL + " SELECT DISTINCT state, county FROM sp")
def distinct_areas(spark, d):
    return ag.distinct_sets(geo_users(spark, d), ["state", "county"])


@proof("split_labels", "F11 F12 F13", """
SELECT event_id, 'i_' || event_type AS id, (['e','p','a'])[event_id%3+1] AS dim, event_type || '_' || (['e','p','a'])[event_id%3+1] AS label,
 CASE (['e','p','a'])[event_id%3+1] WHEN 'e' THEN 'Evaluative' ELSE 'Potency' END AS dim_name,
 CASE WHEN value > 50 THEN event_type END AS shown
FROM events WHERE event_type IN ('click','view','purchase') AND (event_id%3) <> 2""")
def split_labels(spark, d):
    ev = frames.table(spark, d, "events").select("event_id", "event_type", "value")
    raw = ev.withColumn("raw", F.concat(F.lit("i_"), "event_type", F.element_at(F.array(*[F.lit(x) for x in "epa"]), (F.col("event_id") % 3 + 1).cast("int"))))
    id_, dim = filters.split_label(F.col("raw"))
    wanted = ev.where(F.col("event_type").isin("click", "view", "purchase")).select("event_type")
    rows = filters.filter_names(raw.withColumns({"id": id_, "dim": dim}), wanted, "event_type", drop_dim="a")
    return rows.select(
        "event_id", "id", "dim", filters.join_label(F.col("event_type"), F.col("dim")).alias("label"),
        filters.recode(F.col("dim"), {"e": "Evaluative", "p": "Potency"}).alias("dim_name"),
        filters.label_where(F.col("value") > 50, F.col("event_type")).alias("shown"),
    )


@proof("one_dimension", "F12", "SELECT event_id, value FROM events WHERE event_id % 3 = 0")
def one_dimension(spark, d):
    ev = frames.table(spark, d, "events")
    tagged = ev.withColumn("dim", F.element_at(F.array(*[F.lit(x) for x in "epa"]), (F.col("event_id") % 3 + 1).cast("int")))
    return filters.filter_dim(tagged, "e").select("event_id", "value")


# -- users -------------------------------------------------------------------------

SPLIT_SQL = """split AS (SELECT *, CASE WHEN rn <= n - CAST(floor(0.15 * n) AS INT) + 1 THEN 'train' ELSE 'test' END AS split FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events))"""


def split_events(spark, d):
    ev = frames.table(spark, d, "events").drop("props")
    return split_train_test(ev, 0.15, order=["ts", "event_id"], bucket=F.date_trunc("day", F.col("ts")), unit="event_id")


@proof("train_test_split", "W6 U1", "WITH " + SPLIT_SQL + " SELECT event_id, user_id, split FROM split")
def train_test_split(spark, d):
    return split_events(spark, d).select("event_id", "user_id", "split")


@proof("shuffled_split_sizes", "W6", """
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, n - CAST(floor(0.15*n) AS INT) + 1 AS train, CAST(floor(0.15*n) AS INT) - 1 AS test FROM n""")
def shuffled_split_sizes(spark, d):
    s = split_train_test(frames.table(spark, d, "events"), 0.15, unit="event_id", seed=7)
    return s.groupBy("user_id").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


@proof("users_with_enough_units", "F4", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 66)")
def users_with_enough_units(spark, d):
    return filters.filter_min_units(frames.table(spark, d, "events"), 66).select("event_id", "user_id")


@proof("identity_counts", "U3 W8 F5", "WITH " + SPLIT_SQL + """,
vocab AS (SELECT event_type, row_number() OVER (ORDER BY md5(event_type)) - 1 AS idx FROM (SELECT DISTINCT event_type FROM split)),
c AS (SELECT user_id, idx, split, count(*) AS n FROM split JOIN vocab USING (event_type) GROUP BY ALL)
SELECT * FROM c WHERE user_id IN (SELECT user_id FROM c WHERE split='train' GROUP BY 1 HAVING sum(n) > 55)""")
def identity_counts(spark, d):
    s = split_events(spark, d).withColumnRenamed("event_type", "identity")
    c = users.count_matrix(s, stable_index(s, "identity"))
    enough = filters.filter_min_mentions(c.where("split = 'train'"), 55)
    return joins.semi_join(c, enough.select("user_id").distinct(), "user_id")


@proof("count_vectors", "U3", "WITH " + SPLIT_SQL + """,
vocab AS (SELECT event_type, row_number() OVER (ORDER BY md5(event_type)) - 1 AS idx FROM (SELECT DISTINCT event_type FROM split)),
c AS (SELECT user_id, idx, count(*) FILTER (split='train') AS tr, count(*) FILTER (split='test') AS te FROM split JOIN vocab USING (event_type) GROUP BY ALL),
g AS (SELECT u.user_id, v.idx, coalesce(tr,0) AS tr, coalesce(te,0) AS te FROM (SELECT DISTINCT user_id FROM split) u, vocab v LEFT JOIN c ON c.user_id=u.user_id AND c.idx=v.idx)
SELECT user_id, string_agg(CAST(tr AS VARCHAR), ',' ORDER BY idx) AS train, string_agg(CAST(te AS VARCHAR), ',' ORDER BY idx) AS test FROM g GROUP BY 1""")
def count_vectors(spark, d):
    s = split_events(spark, d).withColumnRenamed("event_type", "identity")
    vocab = frames.kept("event_vocab", spark, d, lambda: stable_index(s, "identity"))
    v = users.count_vectors(users.count_matrix(s, vocab), vocab.select(F.max("idx") + 1).scalar())
    return v.select("user_id", *[F.array_join(F.col(c).cast("array<int>").cast("array<string>"), ",").alias(c) for c in ("train", "test")])


@proof("identities_seen_by_many", "F15 A15", """
SELECT s.l_suppkey, p.p_brand, count(*) AS n FROM lineitem s JOIN part p ON p_partkey = l_partkey
WHERE p_brand IN (SELECT p_brand FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 10) GROUP BY ALL""")
def identities_seen_by_many(spark, d):
    m = brand_mentions(spark, d)
    kept = filters.filter_extremes(m, 10)
    return kept.groupBy(F.col("user_id").alias("l_suppkey"), F.col("identity").alias("p_brand")).agg(F.count("*").alias("n"))


def brand_mentions(spark, d):
    """Line items as mentions: the supplier is the user, the brand the identity."""
    li = frames.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return li.join(frames.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("identity"), "p_type", "p_size"), "p_partkey")


@proof("value_sums", "A1 A2", "SELECT user_id, event_type, round(sum(value), 4) AS total, count(value) AS n, round(avg(value), 6) AS val FROM events GROUP BY ALL")
def value_sums(spark, d):
    ev = frames.table(spark, d, "events")
    keys = ["user_id", "event_type"]
    both = joins.natural_join(ag.sum_count_by(ev, keys), ag.mean_by_key(ev, keys))
    return both.select(*keys, F.round("total", 4).alias("total"), "n", F.round("val", 6).alias("val"))


@proof("shrunk_means", "A10 J10", """
WITH per AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY ALL),
base AS (SELECT DISTINCT event_type, length(event_type) * 1.5 AS b FROM events),
avgs AS (SELECT b.event_type, (coalesce(sum(v), 0) + any_value(b.b)) / (count(v) + 1) AS value FROM base b LEFT JOIN per USING (event_type) GROUP BY 1)
SELECT u.user_id, a.event_type, round(coalesce(per.v, a.value), 9) AS value FROM (SELECT DISTINCT user_id, event_type FROM events) u
JOIN avgs a USING (event_type) LEFT JOIN per ON per.user_id = u.user_id AND per.event_type = u.event_type""")
def shrunk_means(spark, d):
    ev = frames.table(spark, d, "events").select("user_id", "event_type", "value")
    per = ag.mean_by_key(ev.where("user_id % 2 = 0"), ["user_id", "event_type"], out="value")
    base = ev.select("event_type").distinct().withColumn("value", F.length("event_type") * 1.5)
    pop = ag.shrunk_mean(per, base, ["event_type"])
    keys = ev.select("user_id", "event_type").distinct()
    out = joins.left_join_default(keys, ["event_type"], per, pop, F.lit(0.0))
    return out.select("user_id", "event_type", F.round("value", 9).alias("value"))


@proof("matrix_margins", "A11", """
WITH c AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1)
SELECT user_id, total, round(ln(total), 6) AS log_total, round(CASE WHEN total > 60 THEN ln(total - 60) END, 6) AS log_above FROM c""")
def matrix_margins(spark, d):
    c = frames.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rounded(ag.margin(c, "user_id", floor=60.0), ["log_total", "log_above"])


@proof("margin_summary", "A11", """
WITH c AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1)
SELECT min(total) AS min, max(total) AS max, round(stddev_pop(total), 6) AS sd, round(median(total), 4) AS median FROM c""")
def margin_summary(spark, d):
    c = frames.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return rounded(ag.margin_summary(ag.margin(c, "user_id")), ["sd", "median"])


@proof("value_quantiles", "A11", """
SELECT l_returnflag, CAST(unnest([0.25, 0.5, 0.9]) AS DOUBLE) AS prob, unnest(q) AS quantile FROM
  (SELECT l_returnflag, list_transform(quantile_cont(l_extendedprice, [0.25, 0.5, 0.9]), lambda x: round(x, 6)) AS q FROM lineitem GROUP BY 1)""")
def value_quantiles(spark, d):
    li = frames.table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(exact_quantiles(li, ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.9]), ["quantile"], 6)


@proof("brand_lists", "A13", "SELECT p_type, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS names FROM part GROUP BY 1")
def brand_lists(spark, d):
    return ag.concat_by_group(frames.table(spark, d, "part"), "p_type", "p_brand")


@proof("strongest_neighbours", "W3 W4", """
WITH c AS (SELECT p_brand AS name, p_type AS variable, count(*) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT * FROM c WHERE name = 'Brand#7' OR variable = 'Brand#7' ORDER BY value DESC, name, variable LIMIT 6""")
def strongest_neighbours(spark, d):
    c = brand_mentions(spark, d).groupBy(F.col("identity").alias("name"), F.col("p_type").alias("variable")).agg(F.count("*").alias("value"))
    return neighbour_top_k(c, "Brand#7", 6)


@proof("melted_measures", "X18", """
SELECT o_orderkey, 'o_totalprice' AS variable, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders""")
def melted_measures(spark, d):
    o = frames.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return ag.unpivot_measures(o, ["o_orderkey"], ["o_totalprice", "o_custkey"])


@proof("spread_measures", "X18", """
SELECT user_id, max(CASE WHEN event_type='click' THEN n END) AS click, max(CASE WHEN event_type='view' THEN n END) AS view,
 max(CASE WHEN event_type='purchase' THEN n END) AS purchase FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""")
def spread_measures(spark, d):
    c = frames.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return ag.spread(c, ["user_id"], "event_type", "n", ["click", "view", "purchase"])


@proof("units_by_user", "U1", "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def units_by_user(spark, d):
    ev = frames.table(spark, d, "events").select(F.concat_ws("\t", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("unit_id"))
    u = users.units_by_user(ev)
    return u.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("unit_id").cast("long")).alias("ids"))
