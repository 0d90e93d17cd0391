"""The registered queries: one for each operator of the notation on distributed data, with equal SQL.

Floats are rounded alike on both sides; positions are zero-based.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .api import apl, j
from .plans.values import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, sf: str, name: str, order: list[str] | None = None, pos: str | None = None) -> Table:
    """A table of a folder; its schema is read from the files once."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return Table(spark.read.schema(_schemas[path]).parquet(path), order, pos)


def events(spark: SparkSession, sf: str) -> Table:
    return read(spark, sf, "events", pos="event_id")


def lineitem(spark: SparkSession, sf: str) -> Table:
    return read(spark, sf, "lineitem", order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def nearest(c: Column, to: int) -> Column:
    """A double to so many places as the SQL rounds it: scaled in binary, halves away from zero, scaled back.

    Spark's own ``round`` goes by the shortest decimal form, so that 0.00655 gives 0.0066 there and 0.0065 here.
    """
    size = F.abs(c) * 10.0**to
    whole = F.rint(size) + F.when(size - F.rint(size) == 0.5, 1.0).otherwise(0.0)  # rint takes halves to the even number
    return F.when(size < float("inf"), F.signum(c) * whole / 10.0**to).otherwise(c)


def rounded(df: DataFrame, *names: str, to: int = 4) -> DataFrame:
    """Rounded, with minus zero as zero."""
    return df.withColumns({n: nearest(F.col(n).cast("double"), to) + F.lit(0.0) for n in names})


def query(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return add


def on_events(name: str, sentence: str, sql: str, pos: bool = True, to: int = 4, language=j, floats: bool = True, **columns: str) -> None:
    """A query over columns of events, ordered by event_id; result column v, with positions if it is a vector."""
    columns = columns or {"x": "value"}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = events(spark, sf)
        df = language(sentence, {h: t[c] for h, c in columns.items()}).to_df("v", **({"pos": "pos"} if pos else {}))
        return rounded(df, "v", to=to) if floats else df

    QUERIES[name] = run
    ORACLE[name] = sql


def v(expr: str, to: int = 4) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {to}) + 0.0 AS v"


# reductions and scalars

on_events("reduce_sum", "+/ {x}", f"SELECT {v('sum(value)', 2)} FROM events", pos=False, to=2)
on_events("reduce_min", "<./ {x}", f"SELECT {v('min(value)')} FROM events", pos=False)
on_events("reduce_max", ">./ {x}", f"SELECT {v('max(value)')} FROM events", pos=False)
on_events("reduce_minus", "-/ {x}", f"SELECT {v('sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END)')} FROM events", pos=False)
on_events("reduce_range", "(>./ - <./) {x}", f"SELECT {v('max(value) - min(value)')} FROM events", pos=False)
on_events("reduce_product", "*/ 1 + {x} % 1000000", f"SELECT {v('exp(sum(ln(1 + value / 1000000)))')} FROM events", pos=False)
on_events("reduce_or", "+./ {x} > 480", "SELECT bool_or(value > 480) AS v FROM events", pos=False, floats=False)
on_events("reduce_and", "*./ {x} > 0", "SELECT bool_and(value > 0) AS v FROM events", pos=False, floats=False)
on_events("reduce_parity", "~:/ {x} > 50", "SELECT (sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) % 2) = 1 AS v FROM events", pos=False, floats=False)
on_events("tally", "# {x}", "SELECT count(*) AS v FROM events", pos=False, floats=False)
on_events("mean_fork", "(+/ % #) {x}", f"SELECT {v('avg(value)')} FROM events", pos=False)
on_events("std_named", "d =. {x} - (+/ % #) {x}\n%: (+/ d * d) % # {x}", f"SELECT {v('stddev_pop(value)')} FROM events", pos=False)
on_events("count_above", "+/ {x} > 40", "SELECT count(*) FILTER (value > 40) AS v FROM events", pos=False, floats=False)
on_events("head", "{. {x}", f"SELECT {v('arg_min(value, event_id)')} FROM events", pos=False)
on_events("tail", "{: {x}", f"SELECT {v('arg_max(value, event_id)')} FROM events", pos=False)
on_events("affine_fold", "([ + 0.5 * ])/ {x}", f"SELECT {v('sum(value * power(0.5, event_id))', 3)} FROM events WHERE event_id < 1000", pos=False, to=3)


@query("weighted_sum", "SELECT ROUND(sum(l_quantity * l_extendedprice), 0) + 0.0 AS v FROM lineitem")
def weighted_sum(spark, sf):
    t = lineitem(spark, sf)
    return rounded(j("+/ {w} * {x}", {"w": t["l_quantity"], "x": t["l_extendedprice"]}).to_df("v"), "v", to=0)


@query("column_sums", "SELECT ROUND(sum(l_quantity), 2) AS a, ROUND(sum(l_extendedprice), 0) AS b, ROUND(sum(l_discount), 2) AS c, ROUND(sum(l_tax), 2) AS d FROM lineitem")
def column_sums(spark, sf):
    df = j("+/ {m}", {"m": lineitem(spark, sf).matrix("l_quantity", "l_extendedprice", "l_discount", "l_tax")}).to_df("a", "b", "c", "d")
    return df.select(F.round("a", 2).alias("a"), F.round("b", 0).alias("b"), F.round("c", 2).alias("c"), F.round("d", 2).alias("d"))


ROWS = "l_quantity, l_extendedprice, l_discount, l_tax"


@query("row_sums", f"SELECT {v('l_quantity + (l_extendedprice + (l_discount + l_tax))', 3)} FROM lineitem")
def row_sums(spark, sf):
    return rounded(j('+/"1 {m}', {"m": lineitem(spark, sf).matrix(*ROWS.split(", "))}).to_df("v"), "v", to=3)


@query("row_max", f"SELECT {v('greatest(l_quantity, l_extendedprice, l_discount, l_tax)')} FROM lineitem")
def row_max(spark, sf):
    return rounded(j('>./"1 {m}', {"m": lineitem(spark, sf).matrix(*ROWS.split(", "))}).to_df("v"), "v")


@query("row_mean", f"SELECT {v('(l_quantity + (l_extendedprice + (l_discount + l_tax))) / 4')} FROM lineitem")
def row_mean(spark, sf):
    return rounded(j('(+/ % #)"1 {m}', {"m": lineitem(spark, sf).matrix(*ROWS.split(", "))}).to_df("v"), "v")


@query("cell_dot", "SELECT vec_id, ROUND(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))), 5) AS v FROM embeddings")
def cell_dot(spark, sf):
    t = read(spark, sf, "embeddings", pos="vec_id")
    return j('+/"1 {e} * {e}', {"e": t.cells("embedding")}).to_df("v", pos="vec_id").withColumn("v", F.round("v", 5))


@query("gram_matrix", "SELECT ROUND(sum(l_quantity * l_quantity), 2) AS aa, ROUND(sum(l_quantity * l_discount), 2) AS ab, ROUND(sum(l_discount * l_quantity), 2) AS ba, ROUND(sum(l_discount * l_discount), 4) AS bb FROM lineitem")
def gram_matrix(spark, sf):
    df = j("(|: {m}) +/ . * {m}", {"m": lineitem(spark, sf).matrix("l_quantity", "l_discount")}).to_df("aa", "ab", "ba", "bb")
    return df.select(F.round("aa", 2).alias("aa"), F.round("ab", 2).alias("ab"), F.round("ba", 2).alias("ba"), F.round("bb", 4).alias("bb"))


@query("matrix_product", "SELECT ROUND(l_quantity + 2 * l_discount, 4) + 0.0 AS a, ROUND(3 * l_quantity - l_discount, 4) + 0.0 AS b FROM lineitem")
def matrix_product(spark, sf):
    df = j("{m} +/ . * 2 2 $ 1 3 2 _1", {"m": lineitem(spark, sf).matrix("l_quantity", "l_discount")}).to_df("a", "b")
    return rounded(df, "a", "b")


@query("dot_product", "SELECT ROUND(sum(l_quantity * l_tax), 2) + 0.0 AS v FROM lineitem")
def dot_product(spark, sf):
    t = lineitem(spark, sf)
    return rounded(j("{w} +/ . * {x}", {"w": t["l_quantity"], "x": t["l_tax"]}).to_df("v"), "v", to=2)


@query("least_squares", "SELECT ROUND(regr_intercept(l_extendedprice, l_quantity), 3) AS a, ROUND(regr_slope(l_extendedprice, l_quantity), 5) AS b FROM lineitem")
def least_squares(spark, sf):
    t = lineitem(spark, sf)
    df = t.frame.df.withColumn("one", F.lit(1.0))
    t = Table(df)
    a = np.ravel(j("{y} %. {m}", {"y": t["l_extendedprice"], "m": t.matrix("one", "l_quantity")}).local())
    return spark.range(1).select(F.round(F.lit(float(a[0])), 3).alias("a"), F.round(F.lit(float(a[1])), 5).alias("b"))


# elementwise

on_events("times_plus", "1 + 2 * {x}", f"SELECT event_id AS pos, {v('1 + 2 * value')} FROM events")
on_events("divide", "{x} % 0.5 - {x} > 50", f"SELECT event_id AS pos, {v('value / (0.5 - CASE WHEN value > 50 THEN 1 ELSE 0 END)')} FROM events")
on_events("divide_by_zero", "{u} % {u} > 100", "SELECT event_id AS pos, CASE WHEN user_id > 100 THEN CAST(user_id AS DOUBLE) WHEN user_id = 0 THEN 0.0 ELSE 1e300 END AS v FROM events", u="user_id")
_divide = QUERIES["divide_by_zero"]
QUERIES["divide_by_zero"] = lambda spark, sf: _divide(spark, sf).withColumn("v", F.when(F.col("v") == float("inf"), 1e300).otherwise(F.col("v")))
on_events("residue", "7 | {u}", "SELECT event_id AS pos, user_id % 7 AS v FROM events", floats=False, u="user_id")
on_events("residue_negative", "_7 | {u}", "SELECT event_id AS pos, -(((-user_id) % 7 + 7) % 7) AS v FROM events", floats=False, u="user_id")
on_events("gcd", "{u} +. 12", "SELECT event_id AS pos, gcd(user_id, 12) AS v FROM events", floats=False, u="user_id")
on_events("lcm", "{u} *. 12", "SELECT event_id AS pos, lcm(user_id, 12) AS v FROM events", floats=False, u="user_id")
on_events("circle", "(1 o. {x}) + 2 o. {x}", f"SELECT event_id AS pos, {v('sin(value) + cos(value)')} FROM events")
on_events("exp_log", "^. 1 + ^ - {x}", f"SELECT event_id AS pos, {v('ln(1 + exp(-value))')} FROM events")
on_events("power_root", "(%: {x}) + {x} ^ 0.25", f"SELECT event_id AS pos, {v('sqrt(value) + power(value, 0.25)')} FROM events")
on_events("floor_ceiling", "(<. {x}) + >. {x} % 2", "SELECT event_id AS pos, CAST(floor(value) + ceil(value / 2) AS BIGINT) AS v FROM events", floats=False)
on_events("min_max", "10 >. {x} <. 50", f"SELECT event_id AS pos, {v('greatest(10, least(value, 50))')} FROM events")
on_events("signum_magnitude", "(* {x} - 50) * | {x} - 50", f"SELECT event_id AS pos, {v('value - 50')} FROM events")
on_events("halve_square", "(-: {x}) + *: {x}", f"SELECT event_id AS pos, {v('value / 2 + value * value')} FROM events")
on_events("increment_not", "(>: {u}) * -. {u}", "SELECT event_id AS pos, (user_id + 1) * (1 - user_id) AS v FROM events", floats=False, u="user_id")
on_events("nand_nor", "({x} > 50) *: ({x} > 20) +: {x} > 40", "SELECT event_id AS pos, NOT (value > 50 AND NOT (value > 20 OR value > 40)) AS v FROM events", floats=False)
on_events("comparisons", "({x} >: 10) + ({x} <: 20) + {x} ~: 30", "SELECT event_id AS pos, CAST(value >= 10 AS BIGINT) + CAST(value <= 20 AS BIGINT) + CAST(value <> 30 AS BIGINT) AS v FROM events", floats=False)
on_events("bitwise", "{u} 17 b. 13", "SELECT event_id AS pos, user_id & 13 AS v FROM events", floats=False, u="user_id")
on_events("boolean_table", "({x} > 50) 6 b. {x} < 100", "SELECT event_id AS pos, (value > 50) <> (value < 100) AS v FROM events", floats=False)
on_events("polynomial", "3 _2 0.5 p. {x}", f"SELECT event_id AS pos, {v('3 - 2 * value + 0.5 * value * value', 7)} FROM events", to=7)
on_events("factorial", "! 5 | {u}", "SELECT event_id AS pos, CAST(factorial(CAST(user_id % 5 AS INTEGER)) AS DOUBLE) AS v FROM events", floats=False, u="user_id")
on_events("tolerant_equal", "+/ {x} = {x} + 1e_15 * {x}", "SELECT count(*) AS v FROM events", pos=False, floats=False)
on_events("pi_times", "o. {x}", f"SELECT event_id AS pos, {v('pi() * value')} FROM events")
on_events("agenda", "(-: ` +: @. (>&50)) {x}", f"SELECT event_id AS pos, {v('CASE WHEN value > 50 THEN 2 * value ELSE value / 2 END')} FROM events")
on_events("hook_bond", "(- 10&|) {u}", "SELECT event_id AS pos, user_id - user_id % 10 AS v FROM events", floats=False, u="user_id")
on_events("format_text", '6j1 ": {x}', "SELECT event_id AS pos, lpad(printf('%.1f', value), 6, ' ') AS v FROM events", floats=False)
on_events("explicit_verb", "scale =. 3 : 'lo =. <./ y\n(y - lo) % (>./ y) - lo'\nscale {x}", f"SELECT event_id AS pos, {v('(value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events)')} FROM events")


@query("decode_rows", "SELECT (l_linenumber * 10) + l_partkey AS v FROM lineitem")
def decode_rows(spark, sf):
    return j("10 #. {m}", {"m": lineitem(spark, sf).matrix("l_linenumber", "l_partkey")}).to_df("v")


@query("digits", "SELECT event_id AS pos, (user_id // 60) % 24 AS a, user_id % 60 AS b FROM events")
def digits(spark, sf):
    return j("24 60 #: {u}", {"u": events(spark, sf)["user_id"]}).to_df("a", "b", pos="pos")


@query("outer_product", "SELECT event_id AS pos, ROUND(value, 4) AS a, ROUND(value * 2, 4) AS b, ROUND(value * 3, 4) AS c FROM events")
def outer_product(spark, sf):
    return rounded(j("{x} */ 1 2 3", {"x": events(spark, sf)["value"]}).to_df("a", "b", "c", pos="pos"), "a", "b", "c")


@query("table_of_pairs", "SELECT n_nationkey * 5 + r_regionkey AS pos, CAST(n_nationkey * r_regionkey AS BIGINT) AS v FROM nation, region")
def table_of_pairs(spark, sf):
    n, r = read(spark, sf, "nation", pos="n_nationkey"), read(spark, sf, "region", pos="r_regionkey")
    return j(", {n} */ {r}", {"n": n["n_nationkey"], "r": r["r_regionkey"]}).to_df("v", pos="pos")


@query("oblique", "SELECT d AS pos, ROUND(sum(x), 4) + 0.0 AS v FROM (SELECT event_id AS d, value AS x FROM events UNION ALL SELECT event_id + 1, CAST(user_id AS DOUBLE) FROM events) GROUP BY d")
def oblique(spark, sf):
    t = events(spark, sf)
    t = Table(t.frame.df.withColumn("u", F.col("user_id").cast("double")), pos="event_id")
    return rounded(j("+//. {m}", {"m": t.matrix("value", "u")}).to_df("v", pos="pos"), "v")


# selection and structure

on_events("filter_copy", "({x} > 40) # {x}", f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, {v('value')} FROM events WHERE value > 40")
on_events("replicate", "(3 | {u}) # {u}", "SELECT row_number() OVER (ORDER BY event_id, k) - 1 AS pos, user_id AS v FROM events, (VALUES (1), (2)) t(k) WHERE k <= user_id % 3", floats=False, u="user_id")
on_events("take", "100 {. {x}", f"SELECT event_id AS pos, {v('value')} FROM events WHERE event_id < 100")
on_events("take_last", "_100 {. {x}", f"SELECT event_id - (SELECT count(*) FROM events) + 100 AS pos, {v('value')} FROM events WHERE event_id >= (SELECT count(*) FROM events) - 100")
on_events("overtake", "5 {. ({x} > 490) # {x}", "SELECT CAST(k AS BIGINT) AS pos, ROUND(coalesce(x, 0.0), 4) + 0.0 AS v FROM (VALUES (0), (1), (2), (3), (4)) t(k) LEFT JOIN (SELECT row_number() OVER (ORDER BY event_id) - 1 AS r, value AS x FROM events WHERE value > 490) ON r = k")
on_events("drop_both", "5 }. _5 }. {x}", f"SELECT event_id - 5 AS pos, {v('value')} FROM events WHERE event_id >= 5 AND event_id < (SELECT count(*) FROM events) - 5")
on_events("reverse", "|. {x}", f"SELECT (SELECT count(*) FROM events) - 1 - event_id AS pos, {v('value')} FROM events")
on_events("rotate", "100 |. {x}", f"SELECT (event_id - 100 + (SELECT count(*) FROM events)) % (SELECT count(*) FROM events) AS pos, {v('value')} FROM events")
on_events("shift_fill", "|.!.0 {x}", f"SELECT event_id AS pos, {v('coalesce(lag(value) OVER (ORDER BY event_id), 0)')} FROM events")
on_events("amend", "_1 (3 5 7)} {x}", f"SELECT event_id AS pos, {v('CASE WHEN event_id IN (3, 5, 7) THEN -1 ELSE value END')} FROM events")
on_events("append", "{x} , 1 2 3", f"SELECT event_id AS pos, {v('value')} FROM events UNION ALL SELECT (SELECT count(*) FROM events) + k, CAST(k + 1 AS DOUBLE) FROM (VALUES (0), (1), (2)) t(k)")
on_events("from_literal", "(5 | {u}) { 10 20 30 40 50", "SELECT event_id AS pos, (user_id % 5 + 1) * 10 AS v FROM events", floats=False, u="user_id")
on_events("from_positions", "{u} { {x}", f"SELECT a.event_id AS pos, {v('b.value')} FROM events a JOIN events b ON a.user_id = b.event_id", x="value", u="user_id")
on_events("find_run", "(3 | {u}) E.~ 1 2", "SELECT event_id AS pos, coalesce(user_id % 3 = 1 AND lead(user_id % 3) OVER (ORDER BY event_id) = 2, false) AS v FROM events", floats=False, u="user_id")
on_events("indices", "I. {x} > 450", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id AS v FROM events WHERE value > 450", floats=False)
on_events("returns", "(1 }. {x}) % _1 }. {x}", f"SELECT event_id - 1 AS pos, {v('value / p')} FROM (SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL")
on_events("match_reversed", "({x} -: |. |. {x}) + 2 * {x} -: |. {x}", "SELECT CAST(1 + 2 * CAST(min(value) = max(value) AS INTEGER) AS BIGINT) AS v FROM events", pos=False, floats=False)
on_events("reshape_rows", '+/"1 (100 50 $ {x})', f"SELECT k // 50 AS pos, {v('sum(value)')} FROM range(5000) t(k) JOIN events ON event_id = k % (SELECT count(*) FROM events) GROUP BY 1")


# sorting, searching and sets

on_events("sort_up", "/:~ {x}", f"SELECT row_number() OVER (ORDER BY value) - 1 AS pos, {v('value')} FROM events")
on_events("top_ten", "10 {. \\:~ {x}", f"SELECT row_number() OVER (ORDER BY value DESC) - 1 AS pos, {v('value')} FROM (SELECT value FROM events ORDER BY value DESC LIMIT 10)")
on_events("grade_up", "/: {x}", "SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS pos, event_id AS v FROM events", floats=False)
on_events("grade_down", "\\: {x}", "SELECT row_number() OVER (ORDER BY value DESC, event_id) - 1 AS pos, event_id AS v FROM events", floats=False)
on_events("ranks", "/: /: {x}", "SELECT event_id AS pos, row_number() OVER (ORDER BY value, event_id) - 1 AS v FROM events", floats=False)
on_events("sort_by", "{x} /: {u}", f"SELECT row_number() OVER (ORDER BY user_id, event_id) - 1 AS pos, {v('value')} FROM events", x="value", u="user_id")
on_events("nub", "~. {u}", "SELECT row_number() OVER (ORDER BY m) - 1 AS pos, user_id AS v FROM (SELECT user_id, min(event_id) AS m FROM events GROUP BY 1)", floats=False, u="user_id")
on_events("nub_strings", "~. {t}", "SELECT row_number() OVER (ORDER BY m) - 1 AS pos, event_type AS v FROM (SELECT event_type, min(event_id) AS m FROM events GROUP BY 1)", floats=False, t="event_type")
on_events("nub_sieve", "~: {u}", "SELECT event_id AS pos, event_id = min(event_id) OVER (PARTITION BY user_id) AS v FROM events", floats=False, u="user_id")
on_events("index_of_list", "3 7 5 i. {u}", "SELECT event_id AS pos, CAST(CASE user_id WHEN 3 THEN 0 WHEN 7 THEN 1 WHEN 5 THEN 2 ELSE 3 END AS BIGINT) AS v FROM events", floats=False, u="user_id")
on_events("member_list", "{u} e. 3 5 7", "SELECT event_id AS pos, user_id IN (3, 5, 7) AS v FROM events", floats=False, u="user_id")
on_events("interval_index", "10 20 40 80 I. {x}", "SELECT event_id AS pos, CAST((value > 10) AS BIGINT) + CAST((value > 20) AS BIGINT) + CAST((value > 40) AS BIGINT) + CAST((value > 80) AS BIGINT) AS v FROM events", floats=False)


@query("index_of_table", "SELECT o_orderkey AS pos, c_custkey AS v FROM orders JOIN customer ON o_custkey = c_custkey")
def index_of_table(spark, sf):
    c, o = read(spark, sf, "customer", pos="c_custkey"), read(spark, sf, "orders", pos="o_orderkey")
    return j("{c} i. {o}", {"c": c["c_custkey"], "o": o["o_custkey"]}).to_df("v", pos="pos")


@query("lookup_join", "SELECT o_orderkey AS pos, ROUND(c_acctbal, 4) + 0.0 AS v FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, sf):
    c, o = read(spark, sf, "customer", pos="c_custkey"), read(spark, sf, "orders", pos="o_orderkey")
    return rounded(j("({c} i. {o}) { {b}", {"c": c["c_custkey"], "b": c["c_acctbal"], "o": o["o_custkey"]}).to_df("v", pos="pos"), "v")


@query("member_table", "SELECT c_custkey AS pos, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS v FROM customer")
def member_table(spark, sf):
    c, o = read(spark, sf, "customer", pos="c_custkey"), read(spark, sf, "orders", pos="o_orderkey")
    return j("{c} e. ({t} > 300000) # {o}", {"c": c["c_custkey"], "o": o["o_custkey"], "t": o["o_totalprice"]}).to_df("v", pos="pos")


@query("less", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey AS v FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def less(spark, sf):
    p, li = read(spark, sf, "part", pos="p_partkey"), lineitem(spark, sf)
    return j("{p} -. ({q} > 49) # {l}", {"p": p["p_partkey"], "q": li["l_quantity"], "l": li["l_partkey"]}).to_df("v", pos="pos")


@query("interval_index_table", "SELECT c_custkey AS pos, (SELECT count(*) FROM supplier WHERE s_acctbal < c_acctbal) AS v FROM customer")
def interval_index_table(spark, sf):
    s, c = read(spark, sf, "supplier", order=["s_acctbal"]), read(spark, sf, "customer", pos="c_custkey")
    return j("{s} I. {c}", {"s": s["s_acctbal"], "c": c["c_acctbal"]}).to_df("v", pos="pos")


# groups and cuts


def keyed(name: str, sentence: str, sql: str, floats: bool = True, language=j, **columns: str) -> None:
    """A query of groups: values in the order of first keys."""
    on_events(name, sentence, f"SELECT row_number() OVER (ORDER BY m) - 1 AS pos, {sql} FROM (SELECT *, min(event_id) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type, m", floats=floats, language=language, **(columns or {"k": "event_type", "x": "value"}))


keyed("key_sum", "{k} +//. {x}", v("sum(value)"))
keyed("key_count", "{k} #/. {x}", "count(*) AS v", floats=False)
keyed("key_mean", "{k} (+/ % #)/. {x}", v("avg(value)"))
keyed("key_max", "{k} >.//. {x}", v("max(value)"))
keyed("key_first", "{k} {./. {x}", v("arg_min(value, event_id)"))
keyed("key_last", "{k} {:/. {x}", v("arg_max(value, event_id)"))
keyed("key_squares", "{k} (+/@:*: % #)/. {x}", v("sum(value * value) / count(*)"))


@query("vwap", "SELECT l_returnflag AS k, ROUND(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS v FROM lineitem GROUP BY 1")
def vwap(spark, sf):
    t = read(spark, sf, "lineitem", order=["l_returnflag"])
    value = j("({k} +//. {p} * {v}) % {k} +//. {v}", {"k": t["l_returnflag"], "p": t["l_extendedprice"], "v": t["l_quantity"]}).value
    return value.frame.df.select(value.keys[0].alias("k"), F.round(value.col, 4).alias("v"))


on_events("keyed_scan", "{k} (+/\\)/. {x}", f"SELECT event_id AS pos, {v('sum(value) OVER (PARTITION BY user_id ORDER BY event_id)')} FROM events", k="user_id", x="value")
on_events("chunk_sum", "_100 +/\\ {x}", f"SELECT event_id // 100 AS pos, {v('sum(value)')} FROM events GROUP BY 1")
on_events("chunk_mean", "_128 (+/ % #)\\ {x}", f"SELECT event_id // 128 AS pos, {v('avg(value)')} FROM events GROUP BY 1")
SEGMENTS = "SELECT *, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS s FROM events"
on_events("cut_starts", "({x} > 100) +/;.1 {x}", f"SELECT s - 1 AS pos, {v('sum(value)')} FROM ({SEGMENTS}) WHERE s > 0 GROUP BY s")
on_events("cut_starts_dropped", "({x} > 100) #;._1 {x}", f"SELECT s - 1 AS pos, count(*) - 1 AS v FROM ({SEGMENTS}) WHERE s > 0 GROUP BY s", floats=False)
ENDS = "SELECT *, CAST(coalesce(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER () AS n FROM events"
on_events("cut_ends", "({x} > 100) >./;.2 {x}", f"SELECT s AS pos, {v('max(value)')} FROM ({ENDS}) WHERE s < n GROUP BY s")


# scans and windows

W = "OVER (ORDER BY event_id)"
on_events("prefix_sum", "+/\\ {x}", f"SELECT event_id AS pos, {v('sum(value) ' + W)} FROM events")
on_events("prefix_max", ">./\\ {x}", f"SELECT event_id AS pos, {v('max(value) ' + W)} FROM events")
on_events("prefix_alternating", "-/\\ {x}", f"SELECT event_id AS pos, {v('sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) ' + W)} FROM events")
# a small offset keeps exact halves from rounding differently on the two sides
on_events("prefix_mean", "1e_7 + (+/ % #)\\ {x}", f"SELECT event_id AS pos, {v('1e-7 + avg(value) ' + W)} FROM events")
on_events("prefix_count", "#\\ {x}", "SELECT event_id AS pos, event_id + 1 AS v FROM events", floats=False)
on_events("prefix_or", "+./\\ {x} > 400", f"SELECT event_id AS pos, bool_or(value > 400) {W} AS v FROM events", floats=False)
on_events("suffix_sum", "+/\\. {x}", f"SELECT event_id AS pos, {v('sum(value) OVER (ORDER BY event_id DESC)')} FROM events")
on_events("suffix_min", "<./\\. {x}", f"SELECT event_id AS pos, {v('min(value) OVER (ORDER BY event_id DESC)')} FROM events")
ROLL = "OVER (ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
on_events("moving_mean", "(20 +/\\ {x}) % 20", f"SELECT event_id - 19 AS pos, v FROM (SELECT event_id, {v('avg(value) ' + ROLL)} FROM events) WHERE event_id >= 19")
on_events("moving_max", "20 >./\\ {x}", f"SELECT event_id - 19 AS pos, v FROM (SELECT event_id, {v('max(value) ' + ROLL)} FROM events) WHERE event_id >= 19")
on_events("moving_fork", "20 (+/ % #)\\ {x}", f"SELECT event_id - 19 AS pos, v FROM (SELECT event_id, {v('avg(value) ' + ROLL)} FROM events) WHERE event_id >= 19")
on_events("moving_range", "20 (>./ - <./)\\ {x}", f"SELECT event_id - 19 AS pos, v FROM (SELECT event_id, {v(f'max(value) {ROLL} - min(value) {ROLL}')} FROM events) WHERE event_id >= 19")
on_events("outfix_sum", "100 +/\\. {x}", f"SELECT event_id - 99 AS pos, v FROM (SELECT event_id, {v('(SELECT sum(value) FROM events) - sum(value) OVER (ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)')} FROM events) WHERE event_id >= 99")
on_events("drawdown", ">./ 1 - {x} % >./\\ {x}", f"SELECT {v('max(d)')} FROM (SELECT 1 - value / max(value) {W} AS d FROM events)", pos=False)
on_events("bollinger_fraction", "m =. (20 +/\\ {x}) % 20\ns =. %: 0 >. ((20 +/\\ *: {x}) % 20) - *: m\n(+/ (19 }. {x}) > m + 2 * s) % # m", f"SELECT {v('avg(CASE WHEN value > m + 2 * s THEN 1.0 ELSE 0.0 END)')} FROM (SELECT value, event_id, avg(value) {ROLL} AS m, stddev_pop(value) {ROLL} AS s FROM events) WHERE event_id >= 19", pos=False)
on_events("peaks", "a =. 1 }. _1 }. {x}\n+/ (a > _2 }. {x}) *. a > 2 }. {x}", "SELECT count(*) AS v FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS p, lead(value) OVER (ORDER BY event_id) AS n FROM events) WHERE value > p AND value > n", pos=False, floats=False)
on_events("golden_cross", "c =. (30 }. (20 +/\\ {x}) % 20) > (50 +/\\ {x}) % 50\n+/ (}. c) > }: c", "SELECT count(*) AS v FROM (SELECT event_id, c, lag(c) OVER (ORDER BY event_id) AS p FROM (SELECT event_id, avg(value) OVER (ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > avg(value) OVER (ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS c FROM events) WHERE event_id >= 49) WHERE c AND NOT p", pos=False, floats=False)
on_events("frame_rms", "%: _1000 (+/ % #)\\ *: {x}", f"SELECT event_id // 1000 AS pos, {v('sqrt(avg(value * value))')} FROM events GROUP BY 1")
on_events("ewma_backward", "([ + 0.5 * ])/\\. {x}", "WITH RECURSIVE t(e, a) AS (SELECT max(event_id), arg_max(value, event_id) FROM events UNION ALL SELECT ev.event_id, ev.value + 0.5 * t.a FROM t JOIN events ev ON ev.event_id = t.e - 1) SELECT e AS pos, ROUND(a, 4) + 0.0 AS v FROM t")


# the second notation

on_events("apl_sum", "+/{x}", f"SELECT {v('sum(value)', 2)} FROM events", pos=False, to=2, language=apl)
on_events("apl_mean", "(+/÷≢){x}", f"SELECT {v('avg(value)')} FROM events", pos=False, language=apl)
on_events("apl_replicate", "({x}>40)/{x}", f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, {v('value')} FROM events WHERE value > 40", language=apl)
on_events("apl_nwise", "20+/{x}", f"SELECT event_id - 19 AS pos, v FROM (SELECT event_id, {v('sum(value) ' + ROLL)} FROM events) WHERE event_id >= 19", language=apl)
on_events("apl_scan", "+\\{x}", f"SELECT event_id AS pos, {v('sum(value) ' + W)} FROM events", language=apl)
on_events("apl_grade", "⍋{x}", "SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS pos, event_id + 1 AS v FROM events", floats=False, language=apl)
on_events("apl_unique", "∪{u}", "SELECT row_number() OVER (ORDER BY m) - 1 AS pos, user_id AS v FROM (SELECT user_id, min(event_id) AS m FROM events GROUP BY 1)", floats=False, language=apl, u="user_id")
on_events("apl_where", "⍸{x}>450", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id + 1 AS v FROM events WHERE value > 450", floats=False, language=apl)
on_events("apl_member", "{u}∊3 5 7", "SELECT event_id AS pos, user_id IN (3, 5, 7) AS v FROM events", floats=False, language=apl, u="user_id")
on_events("apl_dfn", "{(⍵-⌊/⍵)÷(⌈/⍵)-⌊/⍵} {x}", f"SELECT event_id AS pos, {v('(value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events)')} FROM events", language=apl)


keyed("apl_key", "{k}{+/⍵}⌸{x}", v("sum(value)"), language=apl)
keyed("apl_key_range", "{k}{(⌈/⍵)-⌊/⍵}⌸{x}", v("max(value) - min(value)"), language=apl)
on_events("apl_rotate", "100⌽{x}", f"SELECT (event_id - 100 + (SELECT count(*) FROM events)) % (SELECT count(*) FROM events) AS pos, {v('value')} FROM events", language=apl)
on_events("apl_index_of", "3 7 5⍳{u}", "SELECT event_id AS pos, CAST(CASE user_id WHEN 3 THEN 1 WHEN 7 THEN 2 WHEN 5 THEN 3 ELSE 4 END AS BIGINT) AS v FROM events", floats=False, language=apl, u="user_id")
on_events("apl_interval", "0 20 40 80⍸{x}", "SELECT event_id AS pos, 1 + CAST((value >= 20) AS BIGINT) + CAST((value >= 40) AS BIGINT) + CAST((value >= 80) AS BIGINT) AS v FROM events", floats=False, language=apl)
on_events("apl_residue", "¯7|{u}", "SELECT event_id AS pos, -(((-user_id) % 7 + 7) % 7) AS v FROM events", floats=False, language=apl, u="user_id")
on_events("apl_logic", "(({x}>20)∧{x}<60)∨{x}>90", "SELECT event_id AS pos, (value > 20 AND value < 60) OR value > 90 AS v FROM events", floats=False, language=apl)
on_events("apl_named", "d←1↓{x} ⋄ e←¯1↓{x} ⋄ ⌈/d-e", f"SELECT {v('max(d)')} FROM (SELECT value - lag(value) OVER (ORDER BY event_id) AS d FROM events)", pos=False, language=apl)
on_events("sparse_indices", "4 $. ({x} > 450) * {x}", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id AS v FROM events WHERE value > 450", floats=False)
on_events("sparse_values", "5 $. ({x} > 450) * {x}", f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, {v('value')} FROM events WHERE value > 450")
on_events("member_strings", "+/ {t} = 'click'", "SELECT count(*) FILTER (event_type = 'click') AS v FROM events", pos=False, floats=False, t="event_type")
on_events("timestamps", "(>./ - <./) {s}", "SELECT epoch_us(max(ts)) - epoch_us(min(ts)) AS v FROM events", pos=False, floats=False, s="ts")
on_events("memo_fit", "+/ ({x} (=!.0) 6.55)", "SELECT count(*) FILTER (value = 6.55) AS v FROM events", pos=False, floats=False)


@query("key_rows", "SELECT l_returnflag || l_linestatus AS k, count(*) AS v FROM lineitem GROUP BY 1")
def key_rows(spark, sf):
    t = lineitem(spark, sf)
    m = j("{m} #/. {q}", {"m": t.matrix("l_returnflag", "l_linestatus"), "q": t["l_quantity"]}).value
    return m.frame.df.select(F.concat(*m.keys).alias("k"), m.col.alias("v"))


@query("stitch_rows", f"SELECT event_id AS pos, {v('value + user_id')} FROM events")
def stitch_rows(spark, sf):
    t = events(spark, sf)
    return rounded(j('+/"1 {x} ,. {u}', {"x": t["value"], "u": t["user_id"]}).to_df("v", pos="pos"), "v")


@query("transpose_sums", f"SELECT {v('l_quantity + (l_discount + l_tax)')} FROM lineitem")
def transpose_sums(spark, sf):
    return rounded(j("+/ |: {m}", {"m": lineitem(spark, sf).matrix("l_quantity", "l_discount", "l_tax")}).to_df("v"), "v")


@query("cell_scaled", "SELECT vec_id, ROUND(list_max(list_transform(embedding, lambda e: abs(2 * CAST(e AS DOUBLE)))), 5) AS v FROM embeddings")
def cell_scaled(spark, sf):
    t = read(spark, sf, "embeddings", pos="vec_id")
    return j('>./"1 | 2 * {e}', {"e": t.cells("embedding")}).to_df("v", pos="vec_id").withColumn("v", F.round("v", 5))


@query("cell_product", "SELECT vec_id, ROUND(list_sum(list_transform(embedding, lambda e, i: CAST(e AS DOUBLE) * ((i - 1) % 3))), 4) + 0.0 AS v FROM embeddings")
def cell_product(spark, sf):
    t = read(spark, sf, "embeddings", pos="vec_id")
    return rounded(j("{e} +/ . * 3 | i. 64", {"e": t.cells("embedding")}).to_df("v", pos="vec_id"), "v")


@query("apl_intersection", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey AS v FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def apl_intersection(spark, sf):
    c, o = read(spark, sf, "customer", pos="c_custkey"), read(spark, sf, "orders", pos="o_orderkey")
    return apl("{c}∩{o}", {"c": c["c_custkey"], "o": o["o_custkey"]}).to_df("v", pos="pos")


@query("apl_union", "SELECT p_partkey AS v FROM part UNION ALL SELECT s_suppkey + (SELECT count(*) FROM part) - 5 FROM supplier WHERE s_suppkey + (SELECT count(*) FROM part) - 5 NOT IN (SELECT p_partkey FROM part)")
def apl_union(spark, sf):
    p, u = read(spark, sf, "part", pos="p_partkey"), read(spark, sf, "supplier", pos="s_suppkey")
    return apl("{p}∪{s}+(≢{p})-5", {"p": p["p_partkey"], "s": u["s_suppkey"]}).to_df("v")


@query("apl_row_column", "SELECT ROUND(sum(l_quantity), 2) AS a, ROUND(sum(l_discount), 2) AS b FROM lineitem")
def apl_row_column(spark, sf):
    df = apl("+⌿{m}", {"m": lineitem(spark, sf).matrix("l_quantity", "l_discount")}).to_df("a", "b")
    return df.select(F.round("a", 2).alias("a"), F.round("b", 2).alias("b"))


# guards, floats and complex numbers

on_events("log_base", "2 ^. 1 + {x}", f"SELECT event_id AS pos, {v('log2(1 + value)')} FROM events")
on_events("root_three", "3 %: {x}", f"SELECT event_id AS pos, {v('power(value, 1.0 / 3)')} FROM events")
on_events("circle_inverse", "(_3 o. {x}) + _5 o. {x}", f"SELECT event_id AS pos, {v('atan(value) + asinh(value)')} FROM events")
on_events("circle_angle", "12 o. {x} - 50", f"SELECT event_id AS pos, {v('CASE WHEN value < 50 THEN pi() ELSE 0 END')} FROM events")
on_events("factorial_float", "! {x} % 100", f"SELECT event_id AS pos, {v('gamma(value / 100 + 1)')} FROM events")
on_events("binomial", "2 ! {u}", f"SELECT event_id AS pos, {v('user_id * (user_id - 1) / 2')} FROM events", u="user_id")
on_events("primes", "p: 20 | {u}", "SELECT event_id AS pos, CAST([2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71][user_id % 20 + 1] AS BIGINT) AS v FROM events", floats=False, u="user_id")
on_events("prime_factors", '+/"1 q: 2 + 10 | {u}', f"SELECT event_id AS pos, {v('[2, 3, 4, 5, 5, 7, 6, 6, 7, 11][user_id % 10 + 1]')} FROM events", u="user_id")
on_events("complex_magnitude", "| {x} j. {u}", f"SELECT event_id AS pos, {v('sqrt(value * value + user_id * user_id)')} FROM events", x="value", u="user_id")
on_events("complex_polar", "12 o. r. {x} % 1000", f"SELECT event_id AS pos, {v('value / 1000')} FROM events")
on_events("nub_floats", "# ~. 0.1 * {u}", "SELECT count(DISTINCT user_id) AS v FROM events", pos=False, floats=False, u="user_id")
on_events("format_six", '": {x} % 7', "SELECT event_id AS pos, format('{:.6g}', value / 7) AS v FROM events", floats=False)
on_events("code_points", "u: 65 + 26 | {u}", "SELECT event_id AS pos, chr(CAST(65 + user_id % 26 AS INTEGER)) AS v FROM events", floats=False, u="user_id")


def shaped(name: str, sentence: str, names: list[str], sql: str, language=j, **columns: str) -> None:
    """A query over events whose result is a matrix."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = events(spark, sf)
        return rounded(language(sentence, {h: t[c] for h, c in columns.items()}).to_df(*names, pos="pos"), *names)

    QUERIES[name] = run
    ORACLE[name] = sql


shaped("complex_parts", "+. ({x} j. 1) * 0j2 + 0 * {x}", ["a", "b"], "SELECT event_id AS pos, CAST(-2 AS DOUBLE) AS a, ROUND(2 * value, 4) + 0.0 AS b FROM events", x="value")
shaped("polar_real", "*. {x} - 50", ["a", "b"], "SELECT event_id AS pos, ROUND(abs(value - 50), 4) AS a, ROUND(CASE WHEN value < 50 THEN pi() ELSE 0 END, 4) AS b FROM events", x="value")
shaped("binary_digits", "#: 15 | {u}", ["a", "b", "c", "d"], "SELECT event_id AS pos, CAST(m // 8 AS DOUBLE) AS a, CAST(m // 4 % 2 AS DOUBLE) AS b, CAST(m // 2 % 2 AS DOUBLE) AS c, CAST(m % 2 AS DOUBLE) AS d FROM (SELECT event_id, user_id % 15 AS m FROM events)", u="user_id")


@query("roll_mean", "SELECT CAST(4 AS BIGINT) AS v")
def roll_mean(spark, sf):
    """The tens of the mean of so many rolls below 100 are 4."""
    rolls = j("? 100 + 0 * {u}", {"u": events(spark, sf)["user_id"]}).to_df("r")
    return rolls.agg(F.floor((F.avg("r") - 4.5) / 10).alias("v"))


@query("complex_columns", "SELECT ROUND(sum(value), 2) + 0.0 AS re, CAST(sum(user_id) AS DOUBLE) AS im FROM events")
def complex_columns(spark, sf):
    t = Table(spark.read.parquet(f"{sf}/events.parquet").withColumnsRenamed({"value": "z_re", "user_id": "z_im"}), pos="event_id")
    return rounded(j("+/ {z}", {"z": t["z"]}).to_df("v").select("v.re", "v.im"), "re", "im", to=2)


@query("parse_numbers", "SELECT event_id AS pos, CASE WHEN user_id % 3 = 0 THEN -1.0 ELSE value END AS v FROM events")
def parse_numbers(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("p", F.when(F.col("user_id") % 3 == 0, F.lit("none")).otherwise(F.col("value").cast("string")))
    return j('_1 ". {p}', {"p": Table(df, pos="event_id")["p"]}).to_df("v", pos="pos")


# ranks, compositions and any verb over groups, windows, chunks and cuts

on_events("under_rank", "(+/ % #) &.^. 1 + {x}", f"SELECT event_id AS pos, {v('1 + value')} FROM events")
on_events("under_sum", "+/ &.: *: {x}", f"SELECT {v('sqrt(sum(value * value))')} FROM events", pos=False)
on_events("compose", "{x} - &*: {u}", f"SELECT event_id AS pos, {v('value * value - user_id * user_id')} FROM events", x="value", u="user_id")
on_events("power_three", "(1.5&*) ^: 3 {x}", f"SELECT event_id AS pos, {v('3.375 * value')} FROM events")
on_events("fixed_point", "(<. @ -:) ^: _ {u}", "SELECT event_id AS pos, CAST(0 AS BIGINT) AS v FROM events", floats=False, u="user_id")
on_events("last_index", "+/ {u} i: 3 7 5", "SELECT CAST(sum(coalesce(m, (SELECT count(*) FROM events))) AS BIGINT) AS v FROM (VALUES (3), (7), (5)) t(k) LEFT JOIN (SELECT user_id, max(event_id) AS m FROM events GROUP BY 1) ON user_id = k", pos=False, floats=False, u="user_id")
on_events("semi_join", "({u} e. 3 5) # {u}", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, user_id AS v FROM events WHERE user_id IN (3, 5)", floats=False, u="user_id")
on_events("infix_alternating", "3 -/\\ {x}", f"SELECT event_id - 2 AS pos, v FROM (SELECT event_id, {v('lag(value, 2) OVER (ORDER BY event_id) - (lag(value) OVER (ORDER BY event_id) - value)')} FROM events) WHERE event_id >= 2")
on_events("infix_median", "5 (3 : '2 { /:~ y')\\ {x}", f"SELECT event_id - 4 AS pos, v FROM (SELECT event_id, {v('list_sort(list(value) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))[3]')} FROM events) WHERE event_id >= 4")
on_events("infix_nothing", "0 #\\ {x}", "SELECT CAST(k AS BIGINT) AS pos, CAST(0 AS BIGINT) AS v FROM range((SELECT count(*) + 1 FROM events)) t(k)", floats=False)
on_events("chunk_spread", "_100 (3 : '({: - {.) /:~ y')\\ {x}", f"SELECT event_id // 100 AS pos, {v('max(value) - min(value)')} FROM events GROUP BY 1")
keyed("key_median", "{k} (3 : '(<. -: # y) { /:~ y')/. {x}", v("list_sort(list(value))[CAST(floor(count(*) / 2) AS INTEGER) + 1]"))
on_events("cut_any", "({x} > 100) (3 : '{: /:~ y');.1 {x}", f"SELECT s - 1 AS pos, {v('max(value)')} FROM ({SEGMENTS}) WHERE s > 0 GROUP BY s")
on_events("decode_vector", "2 #. 20 {. 2 | {u}", "SELECT CAST(sum((user_id % 2) * CAST(power(2, 19 - event_id) AS BIGINT)) AS BIGINT) AS v FROM events WHERE event_id < 20", pos=False, floats=False, u="user_id")
on_events("ravel_rows", ", {x} ,. {u}", f"SELECT 2 * event_id + k AS pos, {v('CASE k WHEN 0 THEN value ELSE user_id END')} FROM events, (VALUES (0), (1)) t(k)", x="value", u="user_id")
on_events("laminate", "+/ {x} ,: {u}", f"SELECT event_id AS pos, {v('value + user_id')} FROM events", x="value", u="user_id")


@query("zip_tables", f"SELECT event_id AS pos, {v('value + user_id')} FROM events")
def zip_tables(spark, sf):
    return rounded(j("{x} + {u}", {"x": events(spark, sf)["value"], "u": read(spark, sf, "events", order=["event_id"])["user_id"]}).to_df("v", pos="pos"), "v")


@query("each_box", "SELECT vec_id, ROUND(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE))), 4) + 0.0 AS v FROM embeddings")
def each_box(spark, sf):
    t = Table(spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("embedding", F.col("embedding").cast("array<double>")), pos="vec_id")
    return rounded(j("+/&.> {e}", {"e": t["embedding"]}).to_df("v", pos="vec_id"), "v")


@query("words", "SELECT event_id AS pos, CAST(4 AS INTEGER) AS v FROM events")
def words(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("p", F.concat("event_type", F.lit(" =. 1 2+x")))
    return j(";: {p}", {"p": Table(df, pos="event_id")["p"]}).to_df("v", pos="pos").withColumn("v", F.size("v") - F.lit(1))


@query("equal_tables", "SELECT (SELECT min(value) FROM events) = (SELECT max(value) FROM events) AS v")
def equal_tables(spark, sf):
    return j("{x} -: {y}", {"x": events(spark, sf)["value"], "y": j("|. {x}", {"x": events(spark, sf)["value"]}).value}).to_df("v")


on_events("expand", "({x} > 50) #^:_1 ({x} > 50) # {x}", f"SELECT event_id AS pos, {v('CASE WHEN value > 50 THEN value ELSE 0 END')} FROM events")
on_events("raze_boxes", "; _3 <\\ {x}", f"SELECT event_id AS pos, {v('value')} FROM events")
on_events("open_boxes", '+/"1 > _100 <\\ {x}', f"SELECT event_id // 100 AS pos, {v('sum(value)')} FROM events GROUP BY 1")
on_events("level", "(L. _3 <\\ {x}) + 3!:0 {x}", "SELECT CAST(9 AS BIGINT) AS v", pos=False, floats=False)
on_events("amend_many", "(i. 100) (2 * i. 100)} {u}", "SELECT event_id AS pos, CASE WHEN event_id < 200 AND event_id % 2 = 0 THEN event_id // 2 ELSE user_id END AS v FROM events", floats=False, u="user_id")


# more of the second notation

on_events("apl_assign", "A←{x} ⋄ A[2 3]←0 ⋄ A", f"SELECT event_id AS pos, {v('CASE WHEN event_id IN (1, 2) THEN 0 ELSE value END')} FROM events", language=apl)
on_events("apl_enlist", "∊(4|{u})⊂{x}", f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, {v('value')} FROM events WHERE user_id % 4 > 0", language=apl, x="value", u="user_id")
on_events("apl_until", "{⌊⍵÷2}⍣≡{u}", "SELECT event_id AS pos, CAST(0 AS BIGINT) AS v FROM events", floats=False, language=apl, u="user_id")

on_events("apl_nwise_negative", "¯2-/{x}", f"SELECT event_id - 1 AS pos, v FROM (SELECT event_id, {v('value - lag(value) OVER (ORDER BY event_id)')} FROM events) WHERE event_id >= 1", language=apl)
on_events("apl_reshape", "+/100 50⍴{x}", f"SELECT k // 50 AS pos, {v('sum(value)')} FROM range(5000) t(k) JOIN events ON event_id = k % (SELECT count(*) FROM events) GROUP BY 1", language=apl)
on_events("apl_expand", "({x}>50)\\({x}>50)/{x}", f"SELECT event_id AS pos, {v('CASE WHEN value > 50 THEN value ELSE 0 END')} FROM events", language=apl)
on_events("apl_sieve", "≠{u}", "SELECT event_id AS pos, event_id = min(event_id) OVER (PARTITION BY user_id) AS v FROM events", floats=False, language=apl, u="user_id")
on_events("apl_without", "{u}~3 5 7", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, user_id AS v FROM events WHERE user_id NOT IN (3, 5, 7)", floats=False, language=apl, u="user_id")
on_events("apl_nand_nor", "({x}>50)⍲({x}>20)⍱{x}>40", "SELECT event_id AS pos, NOT (value > 50 AND NOT (value > 20 OR value > 40)) AS v FROM events", floats=False, language=apl)
on_events("apl_not", "~{x}>50", "SELECT event_id AS pos, value <= 50 AS v FROM events", floats=False, language=apl)
on_events("apl_take_drop", "+/5↑3↓{x}", f"SELECT {v('sum(value)')} FROM events WHERE event_id BETWEEN 3 AND 7", pos=False, language=apl)
on_events("apl_index", "+/{x}[5 7 9]", f"SELECT {v('sum(value)')} FROM events WHERE event_id IN (4, 6, 8)", pos=False, language=apl)
on_events("apl_find", "1 2⍷3|{u}", "SELECT event_id AS pos, coalesce(user_id % 3 = 1 AND lead(user_id % 3) OVER (ORDER BY event_id) = 2, false) AS v FROM events", floats=False, language=apl, u="user_id")
on_events("apl_format", "⍕{u}", "SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS v FROM events", floats=False, language=apl, u="user_id")
on_events("apl_catenate", "{x},1 2", f"SELECT event_id AS pos, {v('value')} FROM events UNION ALL SELECT (SELECT count(*) FROM events) + k - 1, CAST(k AS DOUBLE) FROM (VALUES (1), (2)) t(k)", language=apl)
on_events("apl_left_right", "({x}⊣{u})+{x}⊢{u}", f"SELECT event_id AS pos, {v('value + user_id')} FROM events", language=apl, x="value", u="user_id")
on_events("apl_compose", "{x}-⍥(×⍨){u}", f"SELECT event_id AS pos, {v('value * value - user_id * user_id')} FROM events", language=apl, x="value", u="user_id")
on_events("apl_power", "(1.5∘×⍣3){x}", f"SELECT event_id AS pos, {v('3.375 * value')} FROM events", language=apl)
on_events("apl_squares", "({x}*2)÷○1", f"SELECT event_id AS pos, {v('value * value / pi()')} FROM events", language=apl)
on_events("apl_match", "({x}≡⌽⌽{x})+2×{x}≢⌽{x}", "SELECT CAST(1 + 2 * CAST(min(value) <> max(value) AS INTEGER) AS BIGINT) AS v FROM events", pos=False, floats=False, language=apl)
on_events("apl_first", "(↑{x})+≢{x}", f"SELECT {v('arg_min(value, event_id) + count(*)')} FROM events", pos=False, language=apl)
on_events("apl_logarithm", "(⍟1+{x})+2⍟1+{x}", f"SELECT event_id AS pos, {v('ln(1 + value) + log2(1 + value)')} FROM events", language=apl)
on_events("apl_decode", "2⊥20↑2|{u}", "SELECT CAST(sum((user_id % 2) * CAST(power(2, 19 - event_id) AS BIGINT)) AS BIGINT) AS v FROM events WHERE event_id < 20", pos=False, floats=False, language=apl, u="user_id")


@query("apl_partition", "SELECT row_number() OVER (ORDER BY min(event_id)) - 1 AS pos, count(*) AS n, ROUND(sum(value), 4) + 0.0 AS v FROM (SELECT *, sum(CASE WHEN r > 0 AND r > coalesce(p, 0) THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS s FROM (SELECT event_id, value, user_id % 4 AS r, lag(user_id % 4) OVER (ORDER BY event_id) AS p FROM events)) WHERE r > 0 GROUP BY s")
def apl_partition(spark, sf):
    t = events(spark, sf)
    runs = apl("(4|{u})⊂{x}", {"u": t["user_id"], "x": t["value"]}).to_df("v", pos="pos")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rounded(runs.select("pos", F.size("v").cast("long").alias("n"), total.alias("v")), "v")


@query("apl_outer", "SELECT n_nationkey * 5 + r_regionkey AS pos, CAST(n_nationkey + r_regionkey AS BIGINT) AS v FROM nation, region")
def apl_outer(spark, sf):
    n, r = read(spark, sf, "nation", pos="n_nationkey"), read(spark, sf, "region", pos="r_regionkey")
    return apl(",{n}∘.+{r}", {"n": n["n_nationkey"], "r": r["r_regionkey"]}).to_df("v", pos="pos")


@query("apl_transpose", f"SELECT {v('l_quantity + (l_discount + l_tax)')} FROM lineitem")
def apl_transpose(spark, sf):
    return rounded(apl("+⌿⍉{m}", {"m": lineitem(spark, sf).matrix("l_quantity", "l_discount", "l_tax")}).to_df("v"), "v")
