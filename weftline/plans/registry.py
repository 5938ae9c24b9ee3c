"""Registered queries over the test tables, each with the SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import (
    and_, between, eq, exists, gt, gt_subquery, gte, ilike, in_array, in_subquery, is_not_null, is_null, like, lt, lte, ne, not_, not_exists, not_in_array, not_in_subquery,
    or_, outer, placeholder, raw, regex_matches, regex_matches_ci, regex_no_match, sql, starts_with,
)
from ..functions.scalars import (
    add, coalesce, contains_search, div, flag_has, flag_has_all, flag_has_none, flag_set, flag_unset, int_div, json_array_some, json_merge, json_select_text, mul,
    normalized_eq, normalized_like, normalized_starts_with, search_normalize, sub,
)
from ..operators.query import Database
from ..operators.write import MutationBatch, Writer
from ..streaming.events import windowed
from .batch import QueryBatch, prepare
from .star import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None):
    """Registers build(db) under its name, with its SQL."""

    def register(build: Callable[[Database], object]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = build(star(spark, sf_dir))
            return got if isinstance(got, DataFrame) else got.df()

        run.__name__ = run.__qualname__ = build.__name__
        QUERIES[build.__name__] = run
        if oracle:
            ORACLE_SQL[build.__name__] = oracle
        return build

    return register


def money(c):
    """Exact sums: decimals add up alike in any order."""
    return c.cast("decimal(18,4)")


MONEY = "cast(sum(cast({} as decimal(18,4))) as double)"
DAY = lambda s: F.lit(s).cast("timestamp_ntz")


# Flagship.


@query(f"""select c_mktsegment as segment, cast(count(*) as integer) as n_orders, {MONEY.format('o_totalprice')} as revenue from orders join customer on o_custkey = c_custkey
where o_orderdate >= timestamp '1996-01-01' group by 1 order by 1""")
def segment_revenue(db):
    return (
        db.orders.where(lambda o: gte(o.o_orderdate, DAY("1996-01-01")))
        .group_by(lambda o: {"segment": o.customer.c_mktsegment})
        .select(lambda g: {"segment": g.key.segment, "n_orders": g.count(), "revenue": g.sum(lambda o: money(o.o_totalprice))})
        .order_by(lambda r: r.segment)
    )


# Scans and filters.


@query("select * from customer")
def scan_entity(db):
    return db.customer


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
def scan_raw_sql(db):
    db.nation.df().createOrReplaceTempView("nation_v")
    db.region.df().createOrReplaceTempView("region_v")
    return db.query("select n_name, r_name from nation_v join region_v on n_regionkey = r_regionkey where r_name = ?", "ASIA")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 10 and l_quantity <= 45 and l_returnflag <> 'N' and l_discount >= 0.03 and l_tax < 0.06")
def filter_cmp(db):
    return db.lineitem.where(lambda x: and_(gt(x.l_quantity, 10), lte(x.l_quantity, 45), ne(x.l_returnflag, "N"), gte(x.l_discount, 0.03), lt(x.l_tax, 0.06))).select(
        lambda x: {"l_orderkey": x.l_orderkey, "l_linenumber": x.l_linenumber, "l_quantity": x.l_quantity}
    )


@query("select p_partkey, p_size from part where p_size in (1, 5, 9) or (p_size between 20 and 25 and p_brand not in ('Brand#11', 'Brand#12'))")
def filter_in_between(db):
    return db.part.where(lambda p: or_(in_array(p.p_size, [1, 5, 9]), and_(between(p.p_size, 20, 25), not_in_array(p.p_brand, ["Brand#11", "Brand#12"])))).select(lambda p: {"p_partkey": p.p_partkey, "p_size": p.p_size})


@query("select r_regionkey from region where false union all select r_regionkey from region where true")
def filter_empty_lists(db):
    one = db.region.where(lambda r: in_array(r.r_regionkey, [])).select(lambda r: {"r_regionkey": r.r_regionkey})
    return one.union_all(db.region.where(lambda r: and_(not_in_array(r.r_regionkey, []), or_(), and_())).select(lambda r: {"r_regionkey": r.r_regionkey}))


@query("select d.doc_id, l.quality is null as unlabelled from documents d left join labels l using (doc_id) where l.quality is null or l.quality = 1")
def filter_null(db):
    return db.documents.where(lambda d: or_(is_null(d.label.quality), eq(d.label.quality, 1))).select(lambda d: {"doc_id": d.doc_id, "unlabelled": eq(d.label.quality, None)})


@query("select d.doc_id from documents d join labels l using (doc_id) where l.toxic is not null and not (l.toxic = 1)")
def filter_not(db):
    return db.documents.where(lambda d: and_(is_not_null(d.label.toxic), not_(eq(d.label.toxic, 1)))).select(lambda d: {"doc_id": d.doc_id})


@query("""select p_partkey, p_name, p_type from part where p_name like '%1%' and p_type ilike '%STEEL%' or starts_with(p_brand, 'Brand#1') and regexp_matches(p_name, '[0-9]7$')
or regexp_matches(p_type, '(?i)^promo') and not regexp_matches(p_name, '[02468]')""")
def filter_like_regex(db):
    return db.part.where(
        lambda p: or_(
            and_(like(p.p_name, "%1%"), ilike(p.p_type, "%steel%")),
            and_(starts_with(p.p_brand, "Brand#1"), regex_matches(p.p_name, "[0-9]7$")),
            and_(regex_matches_ci(p.p_type, "^promo"), regex_no_match(p.p_name, "[02468]")),
        )
    ).select(lambda p: {"p_partkey": p.p_partkey, "p_name": p.p_name, "p_type": p.p_type})


@query("""select p_partkey, cast(p_size | 64 as integer) as with64, cast(p_size & ~5 as integer) as without5, (p_size & 2) <> 0 as has2 from part
where (p_size & 4) <> 0 and (p_size & 9) = 9 or (p_size & 48) = 0""")
def filter_flags(db):
    return db.part.where(lambda p: or_(and_(flag_has(p.p_size, 4), flag_has_all(p.p_size, 9)), flag_has_none(p.p_size, 48))).select(
        lambda p: {"p_partkey": p.p_partkey, "with64": flag_set(p.p_size, 64), "without5": flag_unset(p.p_size, 5), "has2": flag_has(p.p_size, 2)}
    )


# Projections.


@query("select o_orderkey, o_custkey || ':' || o_orderstatus as who from orders")
def project_struct_flat(db):
    q = db.orders.select(lambda o: {"o_orderkey": o.o_orderkey, "a": {"cust": o.o_custkey, "b": {"status": o.o_orderstatus}}})
    return q.select(lambda r: {"o_orderkey": r.o_orderkey, "who": F.concat_ws(":", r.a["cust"], r.a["b"]["status"])})


@query("select distinct l_returnflag, l_linestatus from lineitem")
def select_distinct(db):
    return db.lineitem.select_distinct(lambda x: {"l_returnflag": x.l_returnflag, "l_linestatus": x.l_linestatus})


@query("select n_name, 5 as five, 'x' as x, true as yes from nation")
def literal_projection(db):
    return db.nation.select(lambda n: {"n_name": n.n_name, "five": 5, "x": "x", "yes": True})


@query("select o_orderkey, cast(year(o_orderdate) as integer) as y, cast(floor(o_totalprice * 2) as bigint) as twice from orders where o_totalprice / 1000 > 100")
def sql_template(db):
    return db.orders.where(lambda o: sql("{} / {} > 100", o.o_totalprice, 1000)).select(lambda o: {"o_orderkey": o.o_orderkey, "y": sql("year({})", o.o_orderdate), "twice": sql("floor({})", o.o_totalprice * 2)})


# Navigation.


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'")
def nav_n1_single(db):
    return db.orders.where(lambda o: eq(o.o_orderstatus, "F")).select(lambda o: {"o_orderkey": o.o_orderkey, "c_name": o.customer.c_name})


@query("""select l_orderkey, l_linenumber, l_extendedprice, n_name, r_name, p_brand from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey where p_size < 10""")
def nav_n1_multi_hop(db):
    return db.lineitem.where(lambda x: lt(x.part.p_size, 10)).select(
        lambda x: {
            "l_orderkey": x.l_orderkey, "l_linenumber": x.l_linenumber, "l_extendedprice": x.l_extendedprice, "n_name": x.order.customer.nation.n_name,
            "r_name": x.order.customer.nation.region.r_name, "p_brand": x.part.p_brand,
        }
    )


@query("select o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_name = 'NATION_3'")
def nav_in_filter(db):
    return db.orders.where(lambda o: eq(o.customer.nation.n_name, "NATION_3")).select(lambda o: {"o_orderkey": o.o_orderkey})


@query("select e.event_id, c.c_name from events e left join customer c on e.user_id = c.c_custkey where e.event_type = 'purchase'")
def nav_optional(db):
    return db.events.where(lambda e: eq(e.event_type, "purchase")).select(lambda e: {"event_id": e.event_id, "c_name": e.customer.c_name})


# Joins.


@query("select c_name, o_orderkey from customer join orders on c_custkey = o_custkey and o_totalprice > c_acctbal * 50")
def join_inner(db):
    return db.customer.inner_join("orders", lambda c, o: and_(eq(c.c_custkey, o.o_custkey), gt(o.o_totalprice, c.c_acctbal * 50)), lambda c, o: {"c_name": c.c_name, "o_orderkey": o.o_orderkey})


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 450000")
def join_left(db):
    return db.customer.left_join("orders", lambda c, o: and_(eq(c.c_custkey, o.o_custkey), gt(o.o_totalprice, 450000)), lambda c, o: {"c_custkey": c.c_custkey, "o_orderkey": o.o_orderkey})


@query("select a.n_name as one, b.n_name as other from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_self(db):
    return db.nation.inner_join("nation", lambda a, b: and_(eq(a.n_regionkey, b.n_regionkey), lt(a.n_nationkey, b.n_nationkey)), lambda a, b: {"one": a.n_name, "other": b.n_name})


@query("select c_custkey, n from customer join (select o_custkey, cast(count(*) as integer) n from orders group by 1) x on c_custkey = o_custkey where n > 12")
def join_subquery(db):
    per = db.orders.group_by(lambda o: {"k": o.o_custkey}).select(lambda g: {"k": g.key.k, "n": g.count()}).query()
    return db.customer.inner_join(per, lambda c, x: eq(c.c_custkey, x.k), lambda c, x: {"c_custkey": c.c_custkey, "n": x.n}).where(lambda r: gt(r.n, 12))


@query("select c.c_custkey, c.c_name from customer c join orders on c_custkey = o_custkey where o_totalprice > 300000")
def join_filter(db):
    return db.customer.join_filter("orders", lambda c, o: eq(c.c_custkey, o.o_custkey), lambda c, o: gt(o.o_totalprice, 300000)).select(lambda c: {"c_custkey": c.c_custkey, "c_name": c.c_name})


@query("select o_orderkey from orders left join lineitem on o_orderkey = l_orderkey where l_orderkey is null")
def anti_join_filter(db):
    return db.orders.left_join_filter("lineitem", lambda o, x: eq(o.o_orderkey, x.l_orderkey), lambda o, x: is_null(x.l_orderkey)).select(lambda o: {"o_orderkey": o.o_orderkey})


@query("select n.n_name, c.c_custkey, o.o_orderkey from nation n join customer c on n_nationkey = c_nationkey left join orders o on c_custkey = o_custkey and o_orderstatus = 'P' where n_regionkey = 1")
def join_multi_way(db):
    return (
        db.nation.where(lambda n: eq(n.n_regionkey, 1))
        .inner_join("customer", lambda n, c: eq(n.n_nationkey, c.c_nationkey))
        .left_join("orders", lambda n, c, o: and_(eq(c.c_custkey, o.o_custkey), eq(o.o_orderstatus, "P")), lambda n, c, o: {"n_name": n.n_name, "c_custkey": c.c_custkey, "o_orderkey": o.o_orderkey})
    )


# Subqueries.


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 48)")
def exists_semi(db):
    return db.orders.where(lambda o: exists(o.lines.where(lambda x: gt(x.l_quantity, 48)))).select(lambda o: {"o_orderkey": o.o_orderkey})


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def not_exists_anti(db):
    return db.orders.where(lambda o: not_exists(o.lines)).select(lambda o: {"o_orderkey": o.o_orderkey})


@query("select c_custkey from customer c where exists (select 1 from orders where o_custkey = c.c_custkey and o_totalprice > 490000)")
def exists_correlated(db):
    return db.customer.where(lambda c: exists(db.orders.where(lambda o: and_(eq(o.o_custkey, outer(c.c_custkey)), gt(o.o_totalprice, 490000))))).select(lambda c: {"c_custkey": c.c_custkey})


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 480000)")
def in_subquery_semi(db):
    return db.customer.where(lambda c: in_subquery(c.c_custkey, db.orders.where(lambda o: gt(o.o_totalprice, 480000)).select(lambda o: {"k": o.o_custkey}))).select(lambda c: {"c_custkey": c.c_custkey})


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def not_in_subquery_anti(db):
    return db.customer.where(lambda c: not_in_subquery(c.c_custkey, db.orders.where(lambda o: gt(o.o_totalprice, 400000)).select(lambda o: {"k": o.o_custkey}))).select(lambda c: {"c_custkey": c.c_custkey})


@query("select o_orderkey from orders where o_totalprice > (select max(o_totalprice) from orders) * 0.95")
def scalar_subquery_cmp(db):
    return db.orders.where(lambda o: gt_subquery(o.o_totalprice, db.orders.aggregate_frame("max", lambda x: x.o_totalprice * 0.95))).select(lambda o: {"o_orderkey": o.o_orderkey})


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'O') as n_open from customer")
def scalar_subquery_select(db):
    return db.customer.select(lambda c: {"c_custkey": c.c_custkey, "n_open": db.orders.where(lambda o: and_(eq(o.o_custkey, outer(c.c_custkey)), eq(o.o_orderstatus, "O"))).count_frame()})


# Aggregates and groups.


@query("select count(*) as count from lineitem join part on l_partkey = p_partkey where p_size > 25")
def agg_count(db):
    return db.lineitem.where(lambda x: gt(x.part.p_size, 25)).count_frame()


@query("select max(o_totalprice) as max from orders")
def agg_max(db):
    return db.orders.aggregate_frame("max", lambda o: o.o_totalprice)


@query("select min(o_orderdate) as min from orders where o_orderstatus = 'P'")
def agg_min(db):
    return db.orders.where(lambda o: eq(o.o_orderstatus, "P")).aggregate_frame("min", lambda o: o.o_orderdate)


@query("select cast(sum(cast(l_extendedprice as decimal(18,4))) as double) as sum from lineitem")
def agg_sum(db):
    return db.lineitem.aggregate_frame("sum", lambda x: money(x.l_extendedprice)).select(F.col("sum").cast("double"))


@query(f"""select l_returnflag as flag, l_linestatus as status, cast(count(*) as integer) as n, {MONEY.format('l_quantity')} as qty, {MONEY.format('l_extendedprice')} as price,
min(l_discount) as low, max(l_discount) as high, cast(cast(sum(cast(l_quantity as bigint)) as bigint) as double) / count(*) as mean
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def group_basic(db):
    return (
        db.lineitem.where(lambda x: lte(x.l_shipdate, DAY("1998-09-02")))
        .group_by(lambda x: {"flag": x.l_returnflag, "status": x.l_linestatus})
        .select(lambda g: {
            "flag": g.key.flag, "status": g.key.status, "n": g.count(), "qty": g.sum(lambda x: money(x.l_quantity)), "price": g.sum(lambda x: money(x.l_extendedprice)),
            "low": g.min(lambda x: x.l_discount), "high": g.max(lambda x: x.l_discount), "mean": g.avg(lambda x: x.l_quantity.cast("long")),
        })
    )


@query(f"""select cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m, cast(count(*) as integer) as n, {MONEY.format('o_totalprice')} as total from orders group by 1, 2""")
def group_expr_key(db):
    return db.orders.group_by(lambda o: {"y": sql("year({})", o.o_orderdate), "m": F.month(o.o_orderdate)}).select(lambda g: {"y": g.key.y, "m": g.key.m, "n": g.count(), "total": g.sum(lambda o: money(o.o_totalprice))})


@query("select o_custkey as k, cast(count(*) as integer) as n from orders group by 1 having count(*) > 14 or max(o_totalprice) > 495000")
def group_having(db):
    return db.orders.group_by(lambda o: {"k": o.o_custkey}).having(lambda g: or_(gt(g.count(), 14), gt(g.max(lambda o: o.o_totalprice), 495000))).select(lambda g: {"k": g.key.k, "n": g.count()})


@query(f"""select n_name, revenue from nation join (select c_nationkey, {MONEY.format('o_totalprice')} revenue from orders join customer on o_custkey = c_custkey group by 1) on n_nationkey = c_nationkey
where revenue > 1000 order by revenue desc, n_name limit 7""")
def group_joined_cte(db):
    revenue = db.cte("revenue", db.orders.group_by(lambda o: {"k": o.customer.c_nationkey}).select(lambda g: {"k": g.key.k, "revenue": g.sum(lambda o: money(o.o_totalprice))}).query())
    return (
        db.nation.inner_join(revenue, lambda n, r: eq(n.n_nationkey, r.k), lambda n, r: {"n_name": n.n_name, "revenue": r.revenue})
        .where(lambda r: gt(r.revenue, 1000))
        .order_by(lambda r: [(r.revenue, "DESC"), r.n_name])
        .limit(7)
    )


@query("select o_orderstatus as s, o_orderpriority as p, cast(count(*) as integer) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def group_rollup(db):
    return db.orders.group_by(lambda o: {"s": o.o_orderstatus, "p": o.o_orderpriority}).rollup().select(lambda g: {"s": g.key.s, "p": g.key.p, "n": g.count()})


@query("select o_orderstatus as s, o_orderpriority as p, cast(count(distinct o_custkey) as integer) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def group_cube_distinct(db):
    return db.orders.group_by(lambda o: {"s": o.o_orderstatus, "p": o.o_orderpriority}).cube().select(lambda g: {"s": g.key.s, "p": g.key.p, "n": g.count_distinct(lambda o: o.o_custkey)})


# Collections.


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey and o_totalprice > 200000) as n from customer")
def coll_count(db):
    return db.customer.select(lambda c: {"c_custkey": c.c_custkey, "n": c.orders.where(lambda o: gt(o.o_totalprice, 200000)).count()})


@query("""select o_orderkey, cast(s as double) as total, low, high from orders left join (select l_orderkey, sum(cast(l_extendedprice as decimal(18,4))) s, min(l_quantity) low, max(l_quantity) high from lineitem group by 1)
on o_orderkey = l_orderkey""")
def coll_sum_min_max(db):
    return db.orders.select(lambda o: {"o_orderkey": o.o_orderkey, "total": o.lines.sum(lambda x: money(x.l_extendedprice)).cast("double"), "low": o.lines.min(lambda x: x.l_quantity), "high": o.lines.max(lambda x: x.l_quantity)})


@query("select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as returned from orders")
def coll_exists(db):
    return db.orders.select(lambda o: {"o_orderkey": o.o_orderkey, "returned": o.lines.where(lambda x: eq(x.l_returnflag, "R")).exists()})


@query("select o_orderkey, coalesce(string_agg(cast(l_partkey as varchar), ',' order by l_partkey), '') as parts from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def coll_number_list(db):
    return db.orders.select(lambda o: {"o_orderkey": o.o_orderkey, "parts": F.array_join(o.lines.order_by(lambda x: x.l_partkey).select(lambda x: x.l_partkey).to_number_list().cast("array<string>"), ",")})


@query("select o_orderkey, coalesce(string_agg(distinct l_returnflag, ',' order by l_returnflag), '') as flags from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def coll_string_list_distinct(db):
    return db.orders.select(lambda o: {"o_orderkey": o.o_orderkey, "flags": F.array_join(o.lines.select_distinct(lambda x: x.l_returnflag).to_string_list(), ",")})


@query("""select c_custkey, coalesce(string_agg(o_orderkey || ':' || n, ',' order by rn), '') as top from customer left join (
select o_custkey, o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) n, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) x
on c_custkey = o_custkey and rn <= 3 group by 1""")
def coll_top_n(db):
    q = db.customer.select(lambda c: {"c_custkey": c.c_custkey, "top": c.orders.select(lambda o: {"k": o.o_orderkey, "n": o.lines.count()}).order_by(lambda o: [(o.o_totalprice, "DESC")]).limit(3).to_list()})
    return q.select(lambda r: {"c_custkey": r.c_custkey, "top": F.array_join(F.transform(r.top, lambda x: F.concat_ws(":", x["k"], x["n"])), ",")})


@query("""select c_custkey, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by rn), '') as page from customer left join (
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from orders) x on c_custkey = o_custkey and rn > 2 and rn <= 5 group by 1""")
def coll_offset(db):
    return db.customer.select(lambda c: {"c_custkey": c.c_custkey, "page": F.array_join(c.orders.order_by(lambda o: o.o_orderdate).select(lambda o: o.o_orderkey).offset(2).limit(3).to_list().cast("array<string>"), ",")})


@query("""select c_custkey, o_orderkey as newest, o_totalprice as price from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) rn from orders) o
on c_custkey = o_custkey and rn = 1""")
def coll_first(db):
    q = db.customer.select(lambda c: {"c_custkey": c.c_custkey, "o": c.orders.order_by(lambda o: [(o.o_orderdate, "DESC")]).select(lambda o: {"k": o.o_orderkey, "p": o.o_totalprice}).first_or_default()})
    return q.select(lambda r: {"c_custkey": r.c_custkey, "newest": r.o["k"], "price": r.o["p"]})


@query("""select c_custkey, count(l_orderkey) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as q from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F'
left join lineitem on o_orderkey = l_orderkey group by 1""")
def coll_select_many(db):
    lines = lambda c: c.orders.where(lambda o: eq(o.o_orderstatus, "F")).select_many(lambda o: o.lines)
    return db.customer.select(lambda c: {"c_custkey": c.c_custkey, "n": lines(c).count(), "q": lines(c).sum(lambda x: x.l_quantity.cast("long"))})


@query("""select r_name, n_name, coalesce(string_agg(s_name, ',' order by s_suppkey), '') as suppliers from region join nation on r_regionkey = n_regionkey left join supplier on n_nationkey = s_nationkey group by 1, 2""")
def coll_nested(db):
    q = db.region.select(lambda r: {"r_name": r.r_name, "nations": r.nations.select(lambda n: {"n": n.n_name, "s": n.suppliers.order_by(lambda s: s.s_suppkey).select(lambda s: s.s_name).to_list()}).to_list()})
    return q.df().select("r_name", F.explode("nations").alias("x")).select("r_name", F.col("x.n").alias("n_name"), F.array_join("x.s", ",").alias("suppliers"))


@query("select c_custkey, cast(coalesce(sum(n), null) as bigint) as lines from customer left join (select o_custkey, (select count(*) from lineitem where l_orderkey = o_orderkey) n from orders) on c_custkey = o_custkey group by 1")
def coll_sum_of_counts(db):
    return db.customer.select(lambda c: {"c_custkey": c.c_custkey, "lines": c.orders.sum(lambda o: o.lines.count())})


@query("""select o_orderkey, (select count(*) from orders x where x.o_custkey = orders.o_custkey) as siblings from orders where o_orderstatus = 'P'""")
def coll_via_reference(db):
    return db.orders.where(lambda o: eq(o.o_orderstatus, "P")).select(lambda o: {"o_orderkey": o.o_orderkey, "siblings": o.customer.orders.count()})


# CTEs.


@query("with big as (select o_custkey, o_totalprice from orders where o_totalprice > 400000) select c_name, o_totalprice from customer join big on c_custkey = o_custkey")
def cte_basic(db):
    big = db.cte("big", db.orders.where(lambda o: gt(o.o_totalprice, 400000)).select(lambda o: {"k": o.o_custkey, "price": o.o_totalprice}))
    return db.customer.inner_join(big, lambda c, b: eq(c.c_custkey, b.k), lambda c, b: {"c_name": c.c_name, "o_totalprice": b.price})


@query("select n_nationkey, coalesce(string_agg(s_suppkey || ':' || s_name, ',' order by s_suppkey), '') as items from nation left join supplier on n_nationkey = s_nationkey and s_acctbal > 5000 group by 1")
def cte_aggregation(db):
    per = db.aggregation_cte("per", db.supplier.where(lambda s: gt(s.s_acctbal, 5000)).select(lambda s: {"n": s.s_nationkey, "k": s.s_suppkey, "name": s.s_name}), lambda r: r.n, "items")
    q = db.nation.left_join(per, lambda n, p: eq(n.n_nationkey, p.n), lambda n, p: {"n_nationkey": n.n_nationkey, "items": p.items})
    return q.select(lambda r: {"n_nationkey": r.n_nationkey, "items": F.array_join(F.transform(F.array_sort(r.items), lambda x: F.concat_ws(":", x["k"], x["name"])), ",")})


@query("select name from (select c_name as name from customer where c_acctbal < 0 union select s_name from supplier where s_acctbal < 0) where name like '%1%'")
def cte_union_body(db):
    both = db.customer.where(lambda c: lt(c.c_acctbal, 0)).select(lambda c: {"name": c.c_name}).union(db.supplier.where(lambda s: lt(s.s_acctbal, 0)).select(lambda s: {"n": s.s_name}))
    return db.select_from_cte(db.cte("both", both.query())).where(lambda b: like(b.name, "%1%"))


SPEND = "(select o_custkey k, cast(count(*) as integer) n from orders where o_totalprice > 480000 group by 1)"


@query(f"select s.n, c.c_custkey from {SPEND} s right join customer c on s.k = c.c_custkey")
def cte_root_right(db):
    spend = db.cte("spend", db.orders.where(lambda o: gt(o.o_totalprice, 480000)).group_by(lambda o: {"k": o.o_custkey}).select(lambda g: {"k": g.key.k, "n": g.count()}).query())
    return db.select_from_cte(spend).right_join("customer", lambda s, c: eq(s.k, c.c_custkey), lambda s, c: {"n": s.n, "c_custkey": c.c_custkey})


@query("select r_name, n_name from region full join nation on true")
def cte_root_full_true(db):
    a = db.cte("a", db.region.select(lambda r: {"r_name": r.r_name}))
    b = db.cte("b", db.nation.select(lambda n: {"n_name": n.n_name}))
    return db.select_from_cte(a).full_outer_join(b, lambda x, y: F.lit(True), lambda x, y: {"r_name": x.r_name, "n_name": y.n_name})


@query("select a.k as ka, b.k as kb from (select o_custkey k from orders where o_totalprice > 495000) a full join (select c_custkey k from customer where c_acctbal > 9500) b on a.k = b.k")
def cte_root_full(db):
    a = db.cte("a", db.orders.where(lambda o: gt(o.o_totalprice, 495000)).select(lambda o: {"k": o.o_custkey}))
    b = db.cte("b", db.customer.where(lambda c: gt(c.c_acctbal, 9500)).select(lambda c: {"k": c.c_custkey}))
    return db.select_from_cte(a).full_outer_join(b, lambda x, y: eq(x.k, y.k), lambda x, y: {"ka": x.k, "kb": y.k})


@query("select r_name, n_name from region cross join nation")
def cte_root_cross(db):
    a = db.cte("a", db.region.select(lambda r: {"r_name": r.r_name}))
    return db.select_from_cte(a).cross_join("nation", lambda x, n: {"r_name": x.r_name, "n_name": n.n_name})


# Set operations.


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(db):
    return db.customer.select(lambda c: {"k": c.c_nationkey}).union(db.supplier.select(lambda s: {"x": s.s_nationkey}))


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def union_all(db):
    return db.customer.select(lambda c: {"k": c.c_nationkey}).union_all(db.supplier.select(lambda s: {"x": s.s_nationkey}))


@query("(select n_regionkey as k from nation union select r_regionkey from region) union all select r_regionkey from region")
def union_mixed(db):
    r = db.region.select(lambda r: {"k": r.r_regionkey})
    return db.nation.select(lambda n: {"k": n.n_regionkey}).union(r).union_all(r)


@query("""select * from (select c_name as name, c_acctbal as bal from customer order by c_acctbal desc, c_name limit 4) union all select * from (select s_name, s_acctbal from supplier order by s_acctbal, s_name limit 4)
order by bal desc, name limit 5 offset 1""")
def union_order_limit(db):
    top = db.customer.select(lambda c: {"name": c.c_name, "bal": c.c_acctbal}).order_by(lambda r: [(r.bal, "DESC"), r.name]).limit(4)
    low = db.supplier.select(lambda s: {"name": s.s_name, "bal": s.s_acctbal}).order_by(lambda r: [r.bal, r.name]).limit(4)
    return top.union_all(low).order_by(lambda u: [(u.bal, "DESC"), u.name]).offset(1).limit(5)


@query("select count(*) as count from (select c_nationkey from customer union select s_nationkey from supplier)")
def union_count(db):
    return db.customer.select(lambda c: {"k": c.c_nationkey}).union(db.supplier.select(lambda s: {"k": s.s_nationkey})).count_frame()


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersect(db):
    return db.customer.select(lambda c: {"k": c.c_nationkey}).intersect(db.supplier.select(lambda s: {"k": s.s_nationkey}))


@query("select p_size as k from part except all select n_nationkey from nation")
def set_except_all(db):
    return db.part.select(lambda p: {"k": p.p_size}).except_all(db.nation.select(lambda n: {"k": n.n_nationkey}))


# Order, limits, pages.


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5")
def top_k(db):
    return db.orders.select(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice}).order_by(lambda o: [(o.o_totalprice, "DESC"), o.o_orderkey]).offset(5).limit(10)


@query("select o_orderkey, o_orderdate, (select count(*) from orders where o_orderstatus = 'O') as total from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 20")
def page_count_over(db):
    q = db.orders.where(lambda o: eq(o.o_orderstatus, "O")).select(lambda o: {"o_orderkey": o.o_orderkey, "o_orderdate": o.o_orderdate})
    return q.order_by(lambda o: [o.o_orderdate, o.o_orderkey]).limit(20).count_over_frame()


@query("select c_custkey, c_nationkey, cast(rank() over (partition by c_nationkey order by c_acctbal desc) as integer) as place from customer")
def window_raw(db):
    return db.customer.select(lambda c: {"c_custkey": c.c_custkey, "c_nationkey": c.c_nationkey, "place": sql("rank() over (partition by {} order by {} desc)", c.c_nationkey, c.c_acctbal)})


# Execution shapes.


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 450000")
def prepared_query(db):
    ready = prepare(lambda: db.orders.where(lambda o: and_(eq(o.o_orderstatus, placeholder("status")), gt(o.o_totalprice, placeholder("low")))).select(lambda o: {"o_orderkey": o.o_orderkey}), "status", "low")
    return ready.bound(status="F", low=450000)


@query("""select 0 as leg, '{"k":' || r_regionkey || ',"name":"' || r_name || '"}' as payload from region union all select 1, '{"count":' || count(*) || '}' from orders
union all select 2, '{"k":' || n_nationkey || '}' from nation where n_nationkey = 24""")
def batch_envelope(db):
    batch = QueryBatch()
    batch.add_list(db.region.select(lambda r: {"k": r.r_regionkey, "name": r.r_name}))
    batch.add_count(db.orders)
    batch.add_first_or_default(db.nation.select(lambda n: {"k": n.n_nationkey}).order_by(lambda n: [(n.k, "DESC")]))
    return batch.frame().select("leg", "payload")


@query("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 1")
def first_or_default(db):
    return db.orders.order_by(lambda o: [(o.o_totalprice, "DESC"), o.o_orderkey]).select(lambda o: {"o_orderkey": o.o_orderkey}).limit(1)


# Scalars.


@query("select event_id, json_extract_string(props, '$.k') as k from events where json_extract_string(props, '$.k') <> '5'")
def json_select_text_q(db):
    return db.events.where(lambda e: ne(json_select_text(e.props, "k"), "5")).select(lambda e: {"event_id": e.event_id, "k": json_select_text(e.props, "k")})


@query("select event_id, json_extract_string(props, '$.k') = '7' as some from events")
def json_array_some_q(db):
    return db.events.select(lambda e: {"event_id": e.event_id, "some": json_array_some(F.concat(F.lit("["), e.props, F.lit("]")), lambda x: x.k == 7)})


@query("""select event_id, json_extract_string(props, '$.k') as k, '9' as extra from events""")
def json_merge_q(db):
    merged = lambda e: json_merge(e.props, '{"extra": 9}')
    return db.events.select(lambda e: {"event_id": e.event_id, "k": json_select_text(merged(e), "k"), "extra": json_select_text(merged(e), "extra")})


@query("""select p_partkey, p_size + 3 + p_size as a, p_size - 1 as s, cast(p_size * 2 as integer) as m, p_retailprice / 4 as d, cast(p_size // 3 as bigint) as q, coalesce(nullif(p_size, 7), -1) as c from part""")
def coalesce_arith(db):
    return db.part.select(
        lambda p: {
            "p_partkey": p.p_partkey, "a": add(p.p_size, 3, p.p_size), "s": sub(p.p_size, 1), "m": mul(p.p_size, 2), "d": div(p.p_retailprice, 4), "q": int_div(p.p_size, 3),
            "c": coalesce(F.nullif(p.p_size, F.lit(7)), -1),
        }
    )


@query("select doc_id, md5(replace(replace(replace(lower(strip_accents(text)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')) as plain from documents where lower(strip_accents(text)) like '%ecole%' or lower(strip_accents(lang)) = 'de' or starts_with(lower(strip_accents(source)), 'src1')")
def search_normalized(db):
    return db.documents.where(lambda d: or_(normalized_like(d.text, contains_search("École")), normalized_eq(d.lang, "DÉ"), normalized_starts_with(d.source, "SRC1"))).select(
        lambda d: {"doc_id": d.doc_id, "plain": F.md5(search_normalize(d.text))}
    )


@query("select date_trunc('month', o_orderdate) as m, cast(count(*) as integer) as n from orders group by 1")
def date_functions(db):
    return db.orders.group_by(lambda o: {"m": sql("date_trunc('month', {})", o.o_orderdate)}).select(lambda g: {"m": g.key.m.cast("timestamp_ntz"), "n": g.count()})


@query("select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n from events group by 1, 2")
def events_windowed(db):
    out = windowed(db.events.df().withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", keys=("event_type",))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


# Writes, as the table's rows afterwards.

NEW = [{"n_nationkey": 3, "n_name": "NEW_3", "n_regionkey": None}, {"n_nationkey": 90, "n_name": "NEW_90", "n_regionkey": 1}]


@query("select n_nationkey, case when n_nationkey = 3 then 'NEW_3' else n_name end as n_name, case when n_nationkey = 3 then null else n_regionkey end as n_regionkey from nation union all select 90, 'NEW_90', 1")
def upsert_state(db):
    return Writer(db, "nation").upsert_bulk(NEW).after


@query("select * from nation union all select 90, 'NEW_90', 1")
def insert_ignore_state(db):
    return Writer(db, "nation").insert_bulk(NEW, on_conflict_do_nothing="n_nationkey").after


@query("select n_nationkey, case when n_regionkey = 2 and n_nationkey > 5 then 'R2' else n_name end as n_name, n_regionkey from nation union all select null, 'R9', 9")
def merge_state(db):
    rows = [{"n_regionkey": 2, "n_name": "R2"}, {"n_regionkey": 9, "n_name": "R9"}]
    return Writer(db, "nation").merge_bulk(rows, on="n_regionkey", match_where=lambda old, new: old.n_nationkey > 5).after


@query("select n_nationkey, case when n_nationkey = 1 then 'ONE' else n_name end as n_name, case when n_nationkey = 2 then 4 else n_regionkey end as n_regionkey from nation")
def bulk_update_state(db):
    return Writer(db, "nation").bulk_update([{"n_nationkey": 1, "n_name": "ONE"}, {"n_nationkey": 2, "n_regionkey": 4}]).after


@query("select c_custkey, c_name, c_nationkey, case when n_regionkey = 0 then c_acctbal + 100 else c_acctbal end as c_acctbal, c_mktsegment from customer join nation on c_nationkey = n_nationkey")
def update_state(db):
    return Writer(db, "customer").update(lambda c: eq(c.nation.n_regionkey, 0), lambda c: {"c_acctbal": c.c_acctbal + 100}).after


@query("select orders.* from orders where not (o_orderstatus = 'P' and not exists (select 1 from lineitem where l_orderkey = o_orderkey))")
def delete_state(db):
    return Writer(db, "orders").delete(lambda o: and_(eq(o.o_orderstatus, "P"), not_exists(o.lines))).after


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey in (4, 8)")
def update_returning(db):
    return Writer(db, "nation").update(lambda n: in_array(n.n_nationkey, [4, 8]), {"n_nationkey": 99}).returning(lambda n: {"n_name": n.n_name, "r_name": n.region.r_name})


@query("select 'region' as t, cast(max(r_regionkey) + 1 as integer) as k, 'ATLANTIS' as name from region union all select 'nation', cast(max(r_regionkey) + 1 as integer), x from region, (values ('N_A'), ('N_B')) v(x) group by x")
def insert_children_state(db):
    children = {"nation": ("n_regionkey", [[{"n_nationkey": 200, "n_name": "N_A"}, {"n_nationkey": 201, "n_name": "N_B"}]])}
    out = Writer(db, "region").insert_with_children({"r_name": "ATLANTIS"}, "r_regionkey", children)
    a = out["region"].affected.select(F.lit("region").alias("t"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return a.union(out["nation"].affected.select(F.lit("nation"), "n_regionkey", "n_name"))


@query("select 'gone' as leg, count(*) as n from nation where n_regionkey = 1 union all select 'renamed', count(*) from nation where n_regionkey in (1, 2) union all select 'new', 2")
def mutation_batch(db):
    b = MutationBatch(db)
    b.add_delete_where_in("gone", "nation", "n_regionkey", [1])
    b.add_update_where_in("renamed", "nation", "n_regionkey", [1, 2], {"n_name": "X"})
    b.add_upsert_bulk("new", "nation", NEW)
    out = None
    for leg, df in b.execute().items():
        part = df.select(F.lit(leg).alias("leg")).groupBy("leg").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("select n_name, 'x' || n_nationkey as tag from nation where n_nationkey > 20 and length(n_name) + n_regionkey > 10")
def raw_condition(db):
    return db.nation.where(lambda n: and_(gt(n.n_nationkey, 20), sql("length({}) + {} > 10", n.n_name, n.n_regionkey))).select(lambda n: {"n_name": n.n_name, "tag": F.concat(raw("'x'"), n.n_nationkey.cast("string"))})


from . import registry_more  # noqa: E402, F401  (it registers its queries with what is defined above)
