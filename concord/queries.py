"""One query for each operator on the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import arith, grammar, output, text
from .operators import collections as co, folds, graph, merge, verbs, vet
from .plans import Schema, above, below, contains, enum, fmt, kind, len_, max_, min_, mulof, must, neq, nof, pattern, rest, unique, when
from .plans.schema import Field, Link, outcome

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _counted(rules: list[tuple[str, str]], source: str) -> str:
    """SQL that counts the rows breaking each condition."""
    return " UNION ALL ".join(f"SELECT '{p}' AS path, '{c.split('|')[0]}' AS code, CAST(count(*) AS BIGINT) AS n FROM {source} WHERE NOT coalesce({c.split('|', 1)[1]}, false)" for p, c in rules)


# ---- validation

LINEITEM = Schema.of(
    l_quantity=kind("float") & min_(1.0) & max_(25.0), l_discount=kind("number") & min_(0.0) & below(0.1), l_returnflag=enum("A", "N"), l_linestatus=enum("O", "F"),
    unique=(("l_orderkey", "l_linenumber"),), links=(Link("l_orderkey", "orders", "o_orderkey"),),
)


@query(
    _counted([("l_discount", "constraint|l_discount >= 0 AND l_discount < 0.1"), ("l_linestatus", "constraint|l_linestatus IN ('O', 'F')"), ("l_quantity", "constraint|l_quantity BETWEEN 1 AND 25"), ("l_returnflag", "constraint|l_returnflag IN ('A', 'N')")], "lineitem")
    + " UNION ALL SELECT 'l_orderkey,l_linenumber', 'unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"
    + " UNION ALL SELECT 'l_orderkey', 'rel_unresolved', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"
)
def vet_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return vet.counts(table(spark, d, "lineitem"), LINEITEM, {"orders": table(spark, d, "orders").select("o_orderkey")})


@query(_counted([("o_orderpriority", "constraint|o_orderpriority >= '2' AND o_orderpriority < '5'"), ("o_totalprice", "constraint|o_totalprice > 1000 AND o_totalprice <= 300000")], "orders"))
def vet_bounds(spark: SparkSession, d: str) -> DataFrame:
    s = Schema.of(o_totalprice=kind("float") & above(1000.0) & max_(300000.0), o_orderpriority=kind("string") & min_("2") & below("5"))
    return vet.counts(table(spark, d, "orders"), s)


@query("SELECT o_orderkey, 'o_orderstatus' AS path, 'constraint' AS code, 'conflict' AS class, o_orderstatus AS actual FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def vet_enum(spark: SparkSession, d: str) -> DataFrame:
    return vet.findings(table(spark, d, "orders"), Schema.of(o_orderstatus=enum("F", "O")), ["o_orderkey"]).drop("expected")


@query(_counted([("p_name", "constraint|typeof(p_name) IN ('BIGINT', 'INTEGER', 'BOOLEAN')"), ("p_partkey", "constraint|typeof(p_partkey) IN ('BIGINT', 'INTEGER')"), ("p_retailprice", "constraint|typeof(p_retailprice) IN ('BIGINT', 'INTEGER', 'DOUBLE')"), ("p_size", "constraint|typeof(p_size) = 'DOUBLE'")], "part"))
def vet_kinds(spark: SparkSession, d: str) -> DataFrame:
    s = Schema.of(p_partkey=kind("integer"), p_size=kind("float"), p_retailprice=kind("number"), p_name=kind("integer") | kind("boolean"))
    return vet.counts(table(spark, d, "part"), s)


@query(_counted([("p_name", "constraint|length(p_name) BETWEEN 10 AND 14"), ("p_type", "constraint|length(p_type) >= 1")], "part"))
def vet_len(spark: SparkSession, d: str) -> DataFrame:
    s = Schema.of(p_name=kind("string") & len_(min_(10) & max_(14)), p_type=kind("string"))
    return vet.counts(table(spark, d, "part"), s)


@query(_counted([("c_name", "constraint|regexp_matches(c_name, '[02468]$')"), ("c_mktsegment", "constraint|regexp_matches(c_mktsegment, '^[A-F][A-Z]+$')")], "customer"))
def vet_re(spark: SparkSession, d: str) -> DataFrame:
    s = Schema.of(c_name=pattern("[02468]$"), c_mktsegment=pattern(r"^[A-F][A-Z]+$"))
    return vet.counts(table(spark, d, "customer"), s)


@query(_counted([("l_linenumber", "constraint|l_linenumber NOT IN (1, 3)"), ("l_returnflag", "constraint|l_returnflag <> 'R'")], "lineitem"))
def vet_neq(spark: SparkSession, d: str) -> DataFrame:
    s = Schema.of(l_linenumber=kind("integer") & neq(1, 3), l_returnflag=kind("string") & neq("R", 7))
    return vet.counts(table(spark, d, "lineitem"), s)


@query(_counted([("l_discount", "constraint|CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(38,12)) % 0.02 = 0"), ("l_quantity", "constraint|CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(38,12)) % 3 = 0")], "lineitem"))
def vet_mulof(spark: SparkSession, d: str) -> DataFrame:
    s = Schema.of(l_quantity=kind("float") & mulof(3), l_discount=kind("float") & mulof(0.02))
    return vet.counts(table(spark, d, "lineitem"), s)


@query(
    "SELECT CASE WHEN c + w > 0 THEN 'invalid' WHEN i > 0 THEN 'incomplete' ELSE 'valid' END AS verdict, c AS conflict, i AS incomplete, w AS table_rules FROM"
    " (SELECT CAST(count(*) FILTER (WHERE o_totalprice > 400000) AS BIGINT) AS c, CAST(0 AS BIGINT) AS i FROM orders),"
    " (SELECT CAST(count(*) AS BIGINT) AS w FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1))"
)
def vet_verdict(spark: SparkSession, d: str) -> DataFrame:
    s = Schema.of(o_totalprice=kind("float") & max_(400000.0), unique=(("o_orderkey",),))
    return vet.verdict(table(spark, d, "orders"), s)


@query(
    "SELECT path, n AS leaves, CASE WHEN path IN ('n_name', 'n_regionkey') THEN n ELSE 0 END AS checked, CASE path WHEN 'n_nationkey' THEN 'unchecked' WHEN 'n_extra' THEN 'unused' ELSE 'checked' END AS state"
    " FROM (SELECT 'n_name' AS path, count(n_name) AS n FROM nation UNION ALL SELECT 'n_nationkey', count(n_nationkey) FROM nation UNION ALL SELECT 'n_regionkey', count(n_regionkey) FROM nation UNION ALL SELECT 'n_extra', 0)"
)
def vet_coverage(spark: SparkSession, d: str) -> DataFrame:
    return vet.coverage(table(spark, d, "nation"), Schema.of(n_name=kind("string"), n_regionkey=kind("integer"), n_extra=Field(optional=True)))


# ---- late atoms


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_by(spark: SparkSession, d: str) -> DataFrame:
    return vet.unique_findings(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def _by_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("numbers"))


@query("SELECT l_orderkey, CAST(count(*) AS INTEGER) AS size FROM lineitem GROUP BY 1 HAVING count(*) = count(DISTINCT l_linenumber) AND count(*) >= 3 AND count(*) FILTER (WHERE l_linenumber >= 4) BETWEEN 1 AND 2")
def contains_count(spark: SparkSession, d: str) -> DataFrame:
    c = unique() & len_(min_(3)) & contains(min_(4), min_(1) & max_(2))
    lists = _by_order(spark, d)
    return co.where(lists, c.test(F.col("numbers"), lists.schema["numbers"].dataType)).select("l_orderkey", F.size("numbers").alias("size"))


@query(_counted([("discount needs quantity", "must|NOT (l_discount > 0.05) OR l_quantity >= 10")], "lineitem"))
def must_rule(spark: SparkSession, d: str) -> DataFrame:
    return vet.counts(table(spark, d, "lineitem"), Schema.of(musts=(("NOT (l_discount > 0.05) OR l_quantity >= 10", "discount needs quantity"),)))


@query(_counted([("p_size", "constraint|((p_size % 2 = 0)::INT + (p_size >= 25)::INT + (p_size < 10)::INT) = 1")], "part"))
def nof_one(spark: SparkSession, d: str) -> DataFrame:
    return vet.counts(table(spark, d, "part"), Schema.of(p_size=kind("integer") & nof(1, mulof(2), min_(25), below(10))))


@query(_counted([("p_retailprice", "constraint|CASE WHEN p_retailprice >= 1500 THEN p_retailprice <= 1900 ELSE p_retailprice >= 1000 END")], "part"))
def when_rule(spark: SparkSession, d: str) -> DataFrame:
    c = when(min_(1500.0), max_(1900.0), min_(1000.0))
    return vet.counts(table(spark, d, "part"), Schema.of(p_retailprice=kind("float") & c & must(min_(0.0), "price")))


@query("SELECT o_custkey, CAST(n AS BIGINT) AS n FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n, bool_and(p <= 200000) AS ok FROM (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS p FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2) GROUP BY 1) WHERE ok")
def rest_rule(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("p"))
    maps = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "p"))).alias("m"))
    c = rest(max_(200000.0), "P")
    n = F.size(F.map_filter("m", lambda k, _: k != "P")).cast("long")
    return co.where(maps, c.test(F.col("m"), maps.schema["m"].dataType) & (n > 0)).select("o_custkey", n.alias("n"))


# ---- folds


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders")
def fold_all(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders")
    return folds.fold(df, total=folds.total(F.col("o_orderkey")), low=folds.least(F.col("o_totalprice")), high=folds.greatest(F.col("o_totalprice")), n=F.count("*"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2")
def fold_groups(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return folds.fold(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], quantity=folds.total(q), low=folds.least(F.col("l_extendedprice")), high=folds.greatest(F.col("l_extendedprice")), n=F.count("*"), suppliers=folds.distinct_count(F.col("l_suppkey")))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name, n_nationkey) AS names FROM nation GROUP BY 1")
def join_text(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold(table(spark, d, "nation"), ["n_regionkey"], names=folds.join(F.col("n_name"), [F.col("n_name"), F.col("n_nationkey")], ", "))


@query("SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def sum_in_row(spark: SparkSession, d: str) -> DataFrame:
    return _by_order(spark, d).select("l_orderkey", folds.sum_in(F.transform("numbers", lambda x: x.cast("long")), F.lit(0).cast("long")).alias("total"))


# ---- selection and construction


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def filter_trial(spark: SparkSession, d: str) -> DataFrame:
    return co.where(table(spark, d, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 100000)).select("o_orderkey", "o_totalprice")


@query("SELECT s_name FROM supplier")
def pick_field(spark: SparkSession, d: str) -> DataFrame:
    return co.pick(table(spark, d, "supplier"), "s_name")


@query("SELECT l_orderkey, list_sort(list(l_linenumber * 10)) AS tens, CAST(count(*) FILTER (WHERE l_linenumber > 2) AS INTEGER) AS n FROM lineitem GROUP BY 1")
def each_in_row(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("numbers")
    return _by_order(spark, d).select("l_orderkey", co.sort_in(co.each_in(x, lambda v: v * 10)).alias("tens"), F.size(co.filter_in(x, lambda v: v > 2)).alias("n"))


@query("SELECT c_custkey, 'customer/' || CAST(c_custkey AS VARCHAR) AS ref, lower(c_mktsegment) AS segment FROM customer")
def each_template(spark: SparkSession, d: str) -> DataFrame:
    return co.each(table(spark, d, "customer"), F.col("c_custkey"), co.apply(F.col("c_custkey"), lambda v: F.concat(F.lit("customer/"), v.cast("string"))).alias("ref"), F.lower("c_mktsegment").alias("segment"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS word FROM orders")
def match_first(spark: SparkSession, d: str) -> DataFrame:
    word = co.match((F.col("o_totalprice") >= 300000, F.lit("large")), (F.col("o_orderstatus") == "F", F.lit("done")), default=F.lit("open"))
    return table(spark, d, "orders").select("o_orderkey", word.alias("word"))


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, array_to_string(list_concat(CASE WHEN min(l_returnflag) <> max(l_returnflag) THEN ['l_returnflag'] ELSE [] END, CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN ['l_linestatus'] ELSE [] END), ',') AS conflict FROM lineitem GROUP BY 1")
def pack_by_key(spark: SparkSession, d: str) -> DataFrame:
    out = co.pack(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")
    return out.withColumn("conflict", F.array_join("conflict", ","))


@query(
    "SELECT n_nationkey, CAST(0 AS INTEGER) AS pos, 'nation ' || n_name AS line FROM nation UNION ALL SELECT n_nationkey, 1, 'region ' || CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_regionkey = 1"
)
def emit_rules(spark: SparkSession, d: str) -> DataFrame:
    name, region = F.concat(F.lit("nation "), "n_name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))
    return co.emit(table(spark, d, "nation"), (F.col("n_regionkey") == 1, [name, region]), (F.lit(True), [name]), order=["n_nationkey"])


@query("SELECT n_regionkey, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) - 1 AS VARCHAR) AS key FROM nation")
def key_index(spark: SparkSession, d: str) -> DataFrame:
    return co.key_index(table(spark, d, "nation"), ["n_name", "n_nationkey"], by=["n_regionkey"]).select("n_regionkey", "n_name", "key")


# ---- order


@query("SELECT CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS VARCHAR) AS pos, s_suppkey, s_acctbal FROM supplier")
def sort_asc(spark: SparkSession, d: str) -> DataFrame:
    return co.key_index(table(spark, d, "supplier"), ["s_acctbal", "s_suppkey"], out="pos").select("pos", "s_suppkey", "s_acctbal")


@query("SELECT CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS VARCHAR) AS pos, p_partkey, p_size FROM part")
def sort_desc_stable(spark: SparkSession, d: str) -> DataFrame:
    return co.key_index(table(spark, d, "part"), [F.desc("p_size"), F.col("p_partkey")], out="pos").select("pos", "p_partkey", "p_size")


@query("SELECT n_regionkey, list(n_name ORDER BY n_name DESC, n_nationkey) AS names FROM nation GROUP BY 1")
def sort_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    return rows.select("n_regionkey", F.transform(co.sort_in(F.col("r"), lambda x: x["n_name"], descending=True), lambda x: x["n_name"]).alias("names"))


# ---- arithmetic

_A = "CAST(c_custkey % 17 - 8 AS BIGINT)"
_B = "CAST(c_custkey % 5 - 2 + CASE WHEN c_custkey % 5 = 2 THEN 3 ELSE 0 END AS BIGINT)"


@query(
    f"SELECT c_custkey, {_A} + {_B} AS added, {_A} - {_B} AS taken, {_A} * {_B} AS times, CAST(trunc(CAST({_A} AS DOUBLE) / {_B}) AS BIGINT) AS quotient, {_A} % {_B} AS remainder,"
    f" CASE WHEN {_A} % {_B} <> 0 AND sign({_A} % {_B}) <> sign({_B}) THEN {_A} % {_B} + {_B} ELSE {_A} % {_B} END AS modulus FROM customer"
)
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    a = k % 17 - 8
    b = k % 5 - 2 + F.when(k % 5 == 2, 3).otherwise(0)
    return table(spark, d, "customer").select(
        "c_custkey", arith.add(a, b).alias("added"), arith.sub(a, b).alias("taken"), arith.mul(a, b).alias("times"),
        arith.div(a, b).alias("quotient"), arith.rem(a, b).alias("remainder"), arith.mod(a, b).alias("modulus"),
    )


@query("SELECT s_suppkey, ceil(s_acctbal) AS up, floor(s_acctbal) AS down, CAST(round_even(CAST(s_acctbal AS DECIMAL(18,4)), 1) AS DOUBLE) AS out FROM supplier")
def rounding(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", arith.upper(x, "float").alias("up"), arith.lower(x, "float").alias("down"), arith.places(x.cast("decimal(18,4)"), 1).cast("double").alias("out"))


@query("SELECT s_suppkey, upper(s_name) AS s_name, CAST(round_even(CAST(s_acctbal AS DECIMAL(18,4)), 0) AS BIGINT)::VARCHAR AS s_acctbal FROM supplier")
def output_records(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("decimal(18,4)").alias("s_acctbal"))
    return output.write_out(df, s_name=output.Output(case="upper"), s_acctbal=output.Output(places=0, kind="string"))


# ---- text


@query("SELECT p_partkey, upper(p_name) AS whole, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS head, left(p_name, length(p_name) - 2) || upper(right(p_name, 2)) AS tail FROM part")
def upper_range(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", text.upper(n).alias("whole"), text.upper(n, 0, 1).alias("head"), text.upper(n, -2).alias("tail"))


@query("SELECT doc_id, translate(text, 'abcdefgh', '12222222') AS padded, translate(text, '0123456789 ', '') AS cut FROM documents")
def translate_pad(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.translate(t, "a-h", "12").alias("padded"), text.translate(t, "0-9 ").alias("cut"))


@query("SELECT page_id, string_split(url, '/') AS fields, CASE WHEN url = '' THEN 1 ELSE len(string_split(url, '')) END AS points FROM pages")
def split_text(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", text.split(u, "/").alias("fields"), F.size(text.split(u, "")).cast("long").alias("points"))


@query(r"SELECT page_id, regexp_replace(url, '([a-z]+)[.]([a-z]+)', '\2.\1', 'g') AS swapped, regexp_replace(url, '[0-9]', '#', 'g') AS masked FROM pages")
def rep_text(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", text.rep(u, "([a-z]+)[.]([a-z]+)", "$2.$1").alias("swapped"), text.rep(u, r"\d", "#").alias("masked"))


@query("SELECT page_id, replace(html, '''', '''''') AS sql, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM pages")
def esc_text(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", text.esc(h, "sql").alias("sql"), text.esc(h, "xml").alias("xml"))


@query("SELECT doc_id, text AS back FROM documents")
def esc_round_trip(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    for v in ("json", "xml", "sql", "uri", "shell"):
        t = text.usc(text.esc(t, v), v)
    return table(spark, d, "documents").select("doc_id", t.alias("back"))


@query("SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS snake, replace(array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1:1]) || w[2:]), ''), ' ', '') AS pascal, upper(replace(p_type, ' ', '_')) AS upper_ FROM part")
def nom_styles(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", text.nom(t, "snake").alias("snake"), text.nom(t, "pascal").alias("pascal"), text.nom(t, "constant").alias("upper_"))


@query("SELECT c_custkey, string_split(c_name, '#')[2] AS digits, regexp_matches(c_name, '^Customer#[0-9]*5$') AS five FROM customer")
def parse_grammar(spark: SparkSession, d: str) -> DataFrame:
    name = 'name = %s"Customer#" digits\ndigits = 1*d\nd = %x30-39\n'
    five = 'name = %s"Customer#" *d %x35\nd = %x30-39\n'
    tree = grammar.parse(name, F.col("c_name"))
    rows = grammar.spread(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "c_name")
    return rows.select("c_custkey", F.variant_get(tree, "$.kids[0].src", "string").alias("digits"), grammar.parses(five, F.col("c_name")).alias("five"))


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey % 5 = 3 THEN 'x' WHEN n_nationkey % 5 IN (1, 2) THEN 'seen' END AS mark, n_nationkey % 5 = 2 AS clash FROM nation WHERE n_nationkey % 5 <> 2 UNION ALL SELECT n_nationkey, NULL, true FROM nation WHERE n_nationkey % 5 = 2")
def link_flow(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    own = n.select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 5 >= 2, F.when(F.col("n_nationkey") % 5 <= 3, F.lit("x"))).alias("mark"))
    links = n.where("n_nationkey % 5 in (1, 2)").select(F.col("n_nationkey").alias("dst"), F.lit("seen").alias("mark"))
    out = graph.link_flow(links, own, "dst", "key", "mark")
    return out.select("key", "mark", (F.size("conflict") > 0).alias("clash"))


# ---- meets, defaults, differences


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))


def _overlay(spark: SparkSession, d: str) -> DataFrame:
    seg = F.when(F.col("c_custkey") % 5 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment"))
    # Every third record stands under a key that the other side does not have.
    key = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") + 1_000_000_000).otherwise(F.col("c_custkey"))
    return table(spark, d, "customer").select(key.alias("c_custkey"), "c_nationkey", seg.alias("c_mktsegment"), F.round("c_acctbal", 2).alias("c_acctbal"))


_X = "(SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"
_Y = "(SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer)"
_CLASH = "x.c_mktsegment IS NOT NULL AND y.c_mktsegment IS NOT NULL AND x.c_mktsegment <> y.c_mktsegment"


@query(f"SELECT c_custkey, coalesce(x.c_nationkey, y.c_nationkey) AS c_nationkey, CASE WHEN NOT ({_CLASH}) THEN coalesce(x.c_mktsegment, y.c_mktsegment) END AS c_mktsegment, y.c_acctbal, CASE WHEN {_CLASH} THEN 'c_mktsegment' ELSE '' END AS conflict FROM {_X} x FULL JOIN {_Y} y USING (c_custkey)")
def meet_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.meet(_customers(spark, d), _overlay(spark, d), ["c_custkey"]).withColumn("conflict", F.array_join("conflict", ","))


@query(f"SELECT c_custkey, 'c_mktsegment' AS path, x.c_mktsegment AS \"left\", y.c_mktsegment AS \"right\" FROM {_X} x JOIN {_Y} y USING (c_custkey) WHERE {_CLASH}")
def meet_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return merge.conflicts(_customers(spark, d), _overlay(spark, d), ["c_custkey"])


@query(f"SELECT c_custkey FROM {_Y} WHERE c_custkey NOT IN (SELECT c_custkey FROM {_X})")
def closed_extra_keys(spark: SparkSession, d: str) -> DataFrame:
    return merge.extra_keys(_overlay(spark, d), _customers(spark, d), ["c_custkey"]).select("c_custkey")


@query(f"SELECT c_custkey, coalesce(x.c_mktsegment, y.c_mktsegment, 'NONE') AS segment, x.c_mktsegment IS NULL AND y.c_mktsegment IS NULL AS by_default FROM {_X} x FULL JOIN {_Y} y USING (c_custkey)")
def defaults_ranked(spark: SparkSession, d: str) -> DataFrame:
    x, y = _customers(spark, d).alias("x"), _overlay(spark, d).alias("y")
    joined = x.join(y, F.col("x.c_custkey") == F.col("y.c_custkey"), "full_outer")
    own, org = F.col("x.c_mktsegment"), F.col("y.c_mktsegment")
    return joined.select(F.coalesce("x.c_custkey", "y.c_custkey").alias("c_custkey"), merge.ranked((2, F.lit("NONE")), (0, own), (1, org)).alias("segment"), (own.isNull() & org.isNull()).alias("by_default"))


@query("SELECT c_custkey, 'C' || CAST(c_custkey AS VARCHAR) AS code, 'retail' AS channel, c_custkey % 2 = 0 AS even FROM customer")
def spread_apply(spark: SparkSession, d: str) -> DataFrame:
    # Two of three records have the code that the template says; the others get it.
    code = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    own = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, code).alias("code"))
    return merge.spread(own, code=code, channel=F.lit("retail"), even=F.col("c_custkey") % 2 == 0)


@query(
    "SELECT l_orderkey, list_transform(range(n), lambda i: CASE WHEN (i + 1) % 3 = 0 AND (i + 1) % 2 = 0 THEN NULL WHEN (i + 1) % 5 = 0 AND (i + 1) % 2 <> 0 AND (i + 1) % 3 <> 0 THEN NULL WHEN (i + 1) % 2 = 0 THEN b[i + 1] ELSE a[i + 1] END) AS met,"
    " list_transform(list_filter(range(n), lambda i: (i + 1) % 5 = 0 AND (i + 1) % 2 <> 0 AND (i + 1) % 3 <> 0), lambda i: CAST(i AS INTEGER)) AS conflict"
    " FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_linenumber) AS a, list(l_partkey ORDER BY l_partkey, l_linenumber) AS b, count(*) AS n FROM lineitem GROUP BY 1)"
)
def meet_by_position(spark: SparkSession, d: str) -> DataFrame:
    # One side lacks every second member, the other every third, and every fifth differs.
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_linenumber"))).alias("r"))
    a = F.transform("r", lambda x, i: F.when((i + 1) % 2 != 0, x["l_partkey"]))
    b = F.transform("r", lambda x, i: F.when((i + 1) % 3 != 0, F.when((i + 1) % 5 == 0, x["l_partkey"] + F.when((i + 1) % 2 == 0, 0).otherwise(1)).otherwise(x["l_partkey"])))
    met = rows.select("l_orderkey", a.alias("a"), b.alias("b")).select("l_orderkey", merge.meet_lists(F.col("a"), F.col("b")).alias("m"))
    return met.select("l_orderkey", F.col("m.list").alias("met"), "m.conflict")


@query(
    f"SELECT c_custkey, path, CASE WHEN l IS NULL THEN 'added' WHEN r IS NULL THEN 'removed' ELSE 'changed' END AS change, l AS \"left\", r AS \"right\" FROM (SELECT c_custkey, unnest([{{'p': 'c_nationkey', 'l': CAST(x.c_nationkey AS VARCHAR), 'r': CAST(y.c_nationkey AS VARCHAR)}}, {{'p': 'c_mktsegment', 'l': x.c_mktsegment, 'r': y.c_mktsegment}}], recursive := true) FROM {_X} x FULL JOIN {_Y} y USING (c_custkey)) t(c_custkey, path, l, r) WHERE l IS DISTINCT FROM r"
)
def diff_paths(spark: SparkSession, d: str) -> DataFrame:
    return merge.diff(_customers(spark, d), _overlay(spark, d).drop("c_acctbal"), ["c_custkey"])


@query("SELECT p_partkey, 'p_size' AS path FROM part WHERE p_size = 10 UNION ALL SELECT p_partkey, 'p_brand' FROM part WHERE p_brand = 'Brand#1' || CAST(p_partkey % 5 + 1 AS VARCHAR)")
def trim_redundant(spark: SparkSession, d: str) -> DataFrame:
    return merge.redundant(table(spark, d, "part"), ["p_partkey"], p_size=F.lit(10), p_brand=F.concat(F.lit("Brand#1"), (F.col("p_partkey") % 5 + 1).cast("string")))


@query("SELECT CAST(r_regionkey AS BIGINT) AS pos, r_name AS name FROM region UNION ALL SELECT n_nationkey + (SELECT max(r_regionkey) + 1 FROM region), n_name FROM nation")
def list_concat(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("name"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"))
    return merge.concat_lists(a, b)


@query(f"SELECT c_custkey, coalesce(y.c_nationkey, x.c_nationkey) AS c_nationkey, coalesce(y.c_mktsegment, x.c_mktsegment) AS c_mktsegment FROM {_X} x FULL JOIN {_Y} y USING (c_custkey)")
def patch_overlay(spark: SparkSession, d: str) -> DataFrame:
    return merge.overlay(_customers(spark, d), _overlay(spark, d), ["c_custkey"])


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def reference_lookup(spark: SparkSession, d: str) -> DataFrame:
    return merge.deref(table(spark, d, "nation"), "n_regionkey", table(spark, d, "region"), "r_regionkey", "r_name").select("n_name", "r_name")


# ---- graphs


def _edges(spark: SparkSession, d: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nation = graph.edges(table(spark, d, "nation"), name("n", "n_nationkey"), {"region": name("r", "n_regionkey")})
    customer = graph.edges(table(spark, d, "customer"), name("c", "c_custkey"), {"nation": name("n", "c_nationkey")})
    supplier = graph.edges(table(spark, d, "supplier"), name("s", "s_suppkey"), {"nation": name("n", "s_nationkey")})
    return graph.union_edges(nation, customer, supplier)


_E = (
    "(SELECT 'n' || n_nationkey AS src, 'region' AS rel, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'nation', 'n' || c_nationkey FROM customer"
    " UNION ALL SELECT 's' || s_suppkey, 'nation', 'n' || s_nationkey FROM supplier)"
)


@query(f"SELECT src, rel, dst FROM {_E}")
def edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"SELECT src, rel, dst FROM {_E} WHERE dst NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)")
def link_dangling(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.dangling(_edges(spark, d), nodes)


@query("SELECT 'n' || n_nationkey AS src, 'in' AS rel, 'r' || n_regionkey AS dst FROM nation WHERE n_nationkey % 4 = 0")
def inverse_missing(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    own, to = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    back = graph.edges(n.where("n_nationkey % 4 <> 0"), to, {"has": own})
    return graph.inverse_missing(graph.union_edges(graph.edges(n, own, {"in": to}), back), "in", "has")


@query(
    f"WITH RECURSIVE e AS (SELECT src, dst FROM {_E}), r AS (SELECT 's' || s_suppkey AS source, 's' || s_suppkey AS node, 0 AS steps FROM supplier UNION ALL SELECT source, dst, steps + 1 FROM r JOIN e ON node = src) SELECT source, node, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY 1, 2"
)
def reaches(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    return graph.reaches(_edges(spark, d), sources)


_RING = "(SELECT CAST(n_nationkey AS VARCHAR) AS src, CAST(CASE WHEN n_nationkey < 7 THEN (n_nationkey + 1) % 7 ELSE n_nationkey - 7 END AS VARCHAR) AS dst FROM nation)"


@query(f"WITH RECURSIVE e AS {_RING}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src) SELECT a AS node FROM r WHERE a = b")
def acyclic_check(spark: SparkSession, d: str) -> DataFrame:
    # A ring of seven nations with tails: only the ring stays.
    n = table(spark, d, "nation")
    ring = n.where("n_nationkey < 7").select(F.col("n_nationkey").cast("string").alias("src"), F.lit("next").alias("rel"), ((F.col("n_nationkey") + 1) % 7).cast("string").alias("dst"))
    tails = n.where("n_nationkey >= 7").select(F.col("n_nationkey").cast("string").alias("src"), F.lit("next").alias("rel"), (F.col("n_nationkey") - 7).cast("string").alias("dst"))
    return graph.cycle_nodes(graph.union_edges(ring, tails), "next")


@query(
    f"WITH e AS (SELECT src, dst FROM {_E}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, CAST(CASE WHEN node NOT IN (SELECT dst FROM e) THEN 0 WHEN node LIKE 'r%' AND EXISTS (SELECT 1 FROM e a JOIN e b ON a.dst = b.src WHERE b.dst = node) THEN 2 ELSE 1 END AS INTEGER) AS layer FROM n"
)
def layering(spark: SparkSession, d: str) -> DataFrame:
    return graph.layers(_edges(spark, d))


@query(f"SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {_E} UNION ALL SELECT dst, 0, 1 FROM {_E}) GROUP BY 1")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


@query("SELECT groups, count(*) AS n FROM (SELECT l_orderkey, string_agg(f, '&' ORDER BY f) AS groups FROM (SELECT DISTINCT l_orderkey, l_returnflag AS f FROM lineitem) GROUP BY 1) GROUP BY 1")
def set_intersections(spark: SparkSession, d: str) -> DataFrame:
    return graph.set_intersections(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


_NEXT = "(SELECT CAST(n_nationkey AS VARCHAR) AS src, CAST((n_nationkey + 1) % (SELECT count(*) FROM nation) AS VARCHAR) AS dst, n_nationkey % 3 = 0 AS back FROM nation)"


@query(
    f"WITH RECURSIVE e AS {_NEXT}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)"
    " SELECT a AS \"at\", 'relation_cycle' AS code, 'next' AS detail FROM r WHERE a = b UNION ALL SELECT src, 'relation_inverse_missing', 'prev ' || dst FROM e WHERE NOT back"
    " UNION ALL SELECT src, 'rel_unresolved', 'next ' || dst FROM e WHERE CAST(dst AS INTEGER) % 7 = 0 UNION ALL SELECT dst, 'rel_unresolved', 'prev ' || src FROM e WHERE back AND CAST(src AS INTEGER) % 7 = 0"
)
def relation_check(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    key = F.col("n_nationkey")
    ring = n.select(key.cast("string").alias("src"), F.lit("next").alias("rel"), ((key + 1) % F.lit(n.count())).cast("string").alias("dst"))
    back = ring.where(F.col("src").cast("int") % 3 == 0).select(F.col("dst").alias("src"), F.lit("prev").alias("rel"), F.col("src").alias("dst"))
    nodes = n.where("n_nationkey % 7 <> 0").select(key.cast("string").alias("node"))
    return graph.relation_check(graph.union_edges(ring, back), ["next"], {"next": "prev"}, nodes)


@query(
    f"WITH RECURSIVE e AS (SELECT src, dst FROM {_E}), r AS (SELECT src AS source, dst AS node, 1 AS steps FROM e UNION ALL SELECT source, dst, steps + 1 FROM r JOIN e ON node = src) SELECT source, node, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY 1, 2"
)
def closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_edges(spark, d))


@query(
    f"WITH RECURSIVE e AS (SELECT src, dst FROM {_E}), r AS (SELECT 's' || s_suppkey AS source, 's' || s_suppkey AS node, 0 AS steps, 's' || s_suppkey AS path FROM supplier UNION ALL SELECT source, dst, steps + 1, path || '>' || dst FROM r JOIN e ON node = src)"
    " SELECT source, node, CAST(steps AS INTEGER) AS steps, path FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY steps, path) AS i FROM r) WHERE i = 1"
)
def reaches_path(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    return graph.reaches(_edges(spark, d), sources, path=True).withColumn("path", F.array_join("path", ">"))


@query(
    "SELECT max(k) AS node, max(k) || '>' || string_agg(k, '>' ORDER BY k) AS path FROM (SELECT n_regionkey, chr(CAST(65 + n_nationkey AS INTEGER)) AS k FROM nation) GROUP BY n_regionkey"
)
def cycle_paths(spark: SparkSession, d: str) -> DataFrame:
    # The nations of each region in a ring, and a way from each ring into the next that closes none.
    n = table(spark, d, "nation").select("n_regionkey", F.char(F.lit(65) + F.col("n_nationkey")).alias("k"))
    rings = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    ring = rings.select(F.explode(F.transform("ks", lambda k, i: F.struct(k.alias("src"), F.get(F.col("ks"), (i + 1) % F.size("ks")).alias("dst")))).alias("e")).select("e.src", F.lit("next").alias("rel"), "e.dst")
    a, b = rings.select("n_regionkey", F.get("ks", F.lit(0)).alias("src")), rings.select((F.col("n_regionkey") - 1).alias("n_regionkey"), F.get("ks", F.lit(0)).alias("dst"))
    way = a.join(b, "n_regionkey").select("src", F.lit("next").alias("rel"), "dst")
    return graph.cycles(graph.union_edges(ring, way), "next").withColumn("path", F.array_join("path", ">"))


@query(
    "WITH RECURSIVE e AS (SELECT n_nationkey AS src, n_nationkey + 1 AS dst FROM nation WHERE n_nationkey % 5 <> 4), v AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 OR n_nationkey = 12 THEN 'v' || n_nationkey END AS v FROM nation),"
    " r AS (SELECT k AS a, k AS b FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)"
    " SELECT CAST(b AS VARCHAR) AS node, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS mark, count(DISTINCT v) > 1 AS clash FROM r JOIN v ON a = k GROUP BY b"
)
def flow_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    links = n.where(k % 5 != 4).select(k.cast("string").alias("src"), F.lit("next").alias("rel"), (k + 1).cast("string").alias("dst"))
    values = n.select(k.alias("node"), F.when((k % 5 == 0) | (k == 12), F.concat(F.lit("v"), k.cast("string"))).alias("mark"))
    return graph.flow(links, values, "node", "mark").select("node", "mark", (F.size("conflict") > 0).alias("clash"))


# ---- verbs


@query(
    f"SELECT c_custkey, 'c_mktsegment' AS path, s AS source, CAST(r AS INTEGER) AS rank, v AS value FROM (SELECT c_custkey, 'base' AS s, 0 AS r, c_mktsegment AS v FROM {_X} UNION ALL SELECT c_custkey, 'overlay', 1, c_mktsegment FROM {_Y}) WHERE v IS NOT NULL"
)
def why_sources(spark: SparkSession, d: str) -> DataFrame:
    return verbs.why({"base": _customers(spark, d), "overlay": _overlay(spark, d)}, ["c_custkey"], ["c_mktsegment"])


@query(
    "SELECT path, CASE WHEN regexp_matches(path, '^region\\.[^.]+\\.secret') THEN 'denied' WHEN regexp_matches(path, '^region\\.ASIA(\\.|$)') OR regexp_matches(path, '^region\\.[^.]+\\.name') THEN 'allowed' ELSE 'uncovered' END AS verdict"
    " FROM (SELECT 'region.' || r_name || '.' || f AS path FROM region, (VALUES ('name'), ('secret'), ('key')) v(f))"
)
def allow_paths(spark: SparkSession, d: str) -> DataFrame:
    parts = F.explode(F.array(*map(F.lit, ("name", "secret", "key"))))
    paths = table(spark, d, "region").select("r_name", parts.alias("f")).select(F.concat_ws(".", F.lit("region"), "r_name", "f").alias("path"))
    return verbs.allow(paths, ["region.ASIA", "region.*.name"], ["region.*.secret"])


@query("SELECT r_regionkey, sha256('{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}') AS hash FROM region")
def canon_hash(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "region")
    return df.select("r_regionkey", verbs.content_hash(df).alias("hash"))


@query(
    "SELECT CAST(0 AS INTEGER) AS depth, '' AS path, CAST(count(*) AS BIGINT) AS weight FROM customer UNION ALL SELECT 1, CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY c_nationkey UNION ALL SELECT 2, CAST(c_nationkey AS VARCHAR) || '.' || c_mktsegment, count(*) FROM customer GROUP BY c_nationkey, c_mktsegment"
)
def tree_weights(spark: SparkSession, d: str) -> DataFrame:
    return verbs.tree_weights(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], F.lit(1))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS file, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def generated_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("file"), "n_nationkey", "n_name")
    return verbs.files(rows, "file", ["n_nationkey"], "n_name")


# ---- variants


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' END AS leaf FROM events")
def variant_get(spark: SparkSession, d: str) -> DataFrame:
    v = F.parse_json("props")
    leaf = F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))
    word = co.match((leaf == "BIGINT", F.lit("integer")), (leaf.isin("DOUBLE", "FLOAT"), F.lit("float")), (leaf == "STRING", F.lit("string")), default=F.lit(None).cast("string"))
    return table(spark, d, "events").select("event_id", co.get(v, "$.k", "long").alias("k"), co.maybe(co.get(v, "$.none", "string")).alias("missing"), word.alias("leaf"))


# ---- more of lists, reports and views


@query("SELECT l_orderkey, a[1] AS first, a[-1] AS last, a[3] AS third FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1)")
def element_at(spark: SparkSession, d: str) -> DataFrame:
    x = F.sort_array("numbers")
    return _by_order(spark, d).select("l_orderkey", co.at(x, 0).alias("first"), co.at(x, -1).alias("last"), co.at(x, 2).alias("third"))


@query(
    "SELECT p_brand, list(CAST(p_partkey AS VARCHAR) || ':' || w ORDER BY p_partkey, i) AS words FROM (SELECT p_brand, p_partkey, unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part) GROUP BY 1"
)
def each_nested(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_type"))).alias("r"))
    words = co.each_nested(F.col("r"), lambda x: F.split(x["p_type"], " "), lambda x, w: F.concat(x["p_partkey"].cast("string"), F.lit(":"), w))
    return rows.select("p_brand", words.alias("words"))


@query(
    "WITH t AS (SELECT r_regionkey, n_nationkey, r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey), l AS ("
    "SELECT r_regionkey, -1 AS a, 0 AS b, 0 AS depth, 'region ' || r_name || ' {' AS line FROM region UNION ALL SELECT r_regionkey, n_nationkey, 0, 1, '  nation ' || replace(n_name, 'I', 'i') FROM t WHERE n_nationkey IS NOT NULL"
    " UNION ALL SELECT r_regionkey, 1000000, 0, 0, '}' FROM region) SELECT 'r' || r_regionkey AS root, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY a) - 1 AS INTEGER) AS pos, CAST(depth AS INTEGER) AS depth, line FROM l"
)
def emit_nested(spark: SparkSession, d: str) -> DataFrame:
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    top = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("i"), F.col("r_name").alias("name"))
    low = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_nationkey").alias("i"), F.replace("n_name", F.lit("I"), F.lit("i")).alias("name"))
    region = [F.concat(F.lit("region "), "name", F.lit(" {")), F.lit("children"), F.lit("}")]
    return co.emit_tree(top.unionByName(low), "key", "parent", (F.col("parent").isNull(), region), (F.lit(True), [F.concat(F.lit("nation "), "name")]), order=["i"], indent="  ")


@query(
    "SELECT o_orderkey, '/' || o_orderkey || '/' || path AS pointer, path, code, class, severity, more FROM (SELECT *, greatest(count(*) OVER (PARTITION BY path) - 3, 0) AS more, row_number() OVER (PARTITION BY path ORDER BY o_orderkey, code) AS i FROM ("
    "SELECT o_orderkey, 'o_totalprice' AS path, 'constraint' AS code, 'conflict' AS class, 'error' AS severity FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, 'o_orderstatus', 'deprecated', 'deprecated', 'warning' FROM orders WHERE o_orderstatus IS NOT NULL)) WHERE i <= 3"
)
def vet_report(spark: SparkSession, d: str) -> DataFrame:
    s = Schema.of(o_totalprice=kind("float") & max_(300000.0), o_orderstatus=Field(kind("string"), deprecated="use o_state"))
    return vet.report(table(spark, d, "orders"), s, ["o_orderkey"], max_errors=3).select("o_orderkey", "pointer", "path", "code", "class", "severity", "more")


@query(
    "SELECT 'day' AS path, 'constraint' AS code, count(*) FILTER (WHERE TRY_CAST(day AS DATE) IS NULL) AS n FROM (SELECT printf('%04d-%02d-%02d', 1896 + c_custkey % 30, 1 + c_custkey % 13, 26 + c_custkey % 7) AS day FROM customer) UNION ALL"
    " SELECT 'host', 'constraint', count(*) FILTER (WHERE c_custkey % 270 > 255 OR c_custkey % 300 > 255) FROM customer UNION ALL SELECT 'mail', 'constraint', count(*) FILTER (WHERE c_custkey % 4 = 0) FROM customer"
)
def vet_formats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    day = F.format_string("%04d-%02d-%02d", F.lit(1896) + k % 30, F.lit(1) + k % 13, F.lit(26) + k % 7)
    host = F.format_string("10.%d.0.%d", k % 270, k % 300)
    mail = F.when(k % 4 == 0, F.concat(F.lit("a..b@"), k.cast("string"))).otherwise(F.concat(F.lit("a.b@h"), k.cast("string"), F.lit(".example")))
    return vet.counts(table(spark, d, "customer").select(day.alias("day"), host.alias("host"), mail.alias("mail")), Schema.of(day=fmt("date"), host=fmt("ipv4"), mail=fmt("email")))


@query("SELECT s_suppkey, s_acctbal + 0.5 AS added, s_acctbal - 2.25 AS taken, s_acctbal * 4 AS times, s_acctbal / 8 AS quotient, -s_acctbal AS negative, CAST(s_suppkey AS VARCHAR) || s_name AS label FROM supplier")
def arithmetic_float(spark: SparkSession, d: str) -> DataFrame:
    x, f = F.col("s_acctbal"), "float"
    return table(spark, d, "supplier").select(
        "s_suppkey", arith.plus(x, F.lit(0.5), f, f).alias("added"), arith.sub(x, F.lit(2.25), f, f).alias("taken"), arith.mul(x, F.lit(4.0), f, f).alias("times"),
        arith.div(x, F.lit(8.0), f, f).alias("quotient"), arith.negative(x, f).alias("negative"), arith.plus(F.col("s_suppkey"), F.col("s_name"), "integer", "string").alias("label"),
    )


@query("SELECT o_orderstatus AS \"row\", o_orderpriority AS \"column\", count(*) AS n FROM orders GROUP BY 1, 2")
def view_matrix(spark: SparkSession, d: str) -> DataFrame:
    return verbs.matrix(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT src, dst, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events) GROUP BY 1, 2")
def view_states(spark: SparkSession, d: str) -> DataFrame:
    return verbs.states(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT user_id AS lane, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step, event_type AS text FROM events")
def view_sequence(spark: SparkSession, d: str) -> DataFrame:
    return verbs.sequence(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT CAST(i AS INTEGER) AS rung, CASE WHEN i > 0 THEN [0.0::DOUBLE, 2500.0, 5000.0][i] END AS low, (SELECT count(*) FROM customer WHERE (c_acctbal >= 0)::INT + (c_acctbal >= 2500)::INT + (c_acctbal >= 5000)::INT = i) AS n FROM range(4) t(i)")
def view_ladder(spark: SparkSession, d: str) -> DataFrame:
    return verbs.ladder(table(spark, d, "customer"), "c_acctbal", [0.0, 2500.0, 5000.0])


_DIVIDES = "(SELECT a.n_nationkey + 1 AS low, b.n_nationkey + 1 AS high FROM nation a JOIN nation b ON (b.n_nationkey + 1) % (a.n_nationkey + 1) = 0)"


def _divides(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("x"))
    high = n.select(F.col("x").alias("low"), F.explode(F.sequence("x", F.lit(25), F.col("x"))).alias("high"))
    return high.join(n.select(F.col("x").alias("high")), "high", "left_semi").select("low", "high")


@query(f"WITH p AS {_DIVIDES} SELECT low, high FROM p WHERE low <> high AND NOT EXISTS (SELECT 1 FROM p a JOIN p b ON a.high = b.low WHERE a.low = p.low AND b.high = p.high AND a.low <> a.high AND b.low <> b.high)")
def view_poset(spark: SparkSession, d: str) -> DataFrame:
    return verbs.covers(_divides(spark, d))


@query("SELECT a.n_nationkey + 1 AS a, b.n_nationkey + 1 AS b, CAST(lcm(a.n_nationkey + 1, b.n_nationkey + 1) AS INTEGER) AS \"join\" FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE lcm(a.n_nationkey + 1, b.n_nationkey + 1) <= 25")
def view_lattice(spark: SparkSession, d: str) -> DataFrame:
    pairs = _divides(spark, d)
    return verbs.lattice(verbs.covers(pairs), pairs)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c.' || c_nationkey || '.' || c_custkey WHEN c_custkey % 3 = 1 THEN 'c.' || c_nationkey END AS met FROM customer")
def path_meet(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    whole, part = verbs.path_of(F.lit("c"), F.col("c_nationkey"), F.col("c_custkey")), verbs.path_of(F.lit("c"), F.col("c_nationkey"))
    other = F.when(F.col("c_custkey") % 3 == 0, whole).when(F.col("c_custkey") % 3 == 1, F.lit("c")).otherwise(F.concat(part, F.lit("0.x")))
    return c.select("c_custkey", verbs.path_meet(part, other).alias("met"))


@query(
    "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, i) - 1 AS INTEGER) AS pos, line FROM ("
    "SELECT l_orderkey, l_linenumber, l_partkey, 0 AS i, 'part ' || l_partkey AS line FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1, '  returned' FROM lineitem WHERE l_returnflag = 'R')"
)
def emit_children(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("items"))
    head = lambda x: F.concat(F.lit("part "), x["l_partkey"].cast("string"))
    # By number and part, what is missing last, and only then by line: several rows of an order may have both in common.
    key = lambda x: F.struct(*[c for n in ("l_linenumber", "l_partkey") for c in (x[n].isNull(), x[n])])
    return co.emit_children(rows, F.col("items"), (lambda x: x["l_returnflag"] == "R", lambda x: [head(x), F.lit("  returned")]), (lambda x: F.lit(True), lambda x: [head(x)]), order=["l_orderkey"], key=key)


# ---- sources


def _folder(spark: SparkSession) -> str:
    import uuid

    from .lineage import shared_dir

    return f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_json_lines(spark: SparkSession, d: str) -> DataFrame:
    from .sources import readers, writers

    at = _folder(spark)
    writers.write_json(table(spark, d, "nation"), at)
    return readers.read_lines(spark, at, "n_nationkey int, n_name string, n_regionkey int")


def _documents(spark: SparkSession, rows: DataFrame, ext: str) -> DataFrame:
    """Documents written as files of an extension and read back: (path, value)."""
    from .sources import readers

    at = _folder(spark)
    rows.select("text").repartition(1).write.option("lineSep", "\n").text(at)
    # A writer's files have names of their own; a reader goes by the extension.
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(at)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("part-"):
            fs.rename(f.getPath(), hadoop.Path(f"{at}/{name.split('.')[0]}.{ext}"))
    return readers.read(spark, f"{at}/*.{ext}")


@query("SELECT r_regionkey, r_name FROM region")
def source_relaxed(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    entry = F.concat(F.lit("  {key: "), F.col("r_regionkey").cast("string"), F.lit(", name: '"), "r_name", F.lit("',}, // one\n"))
    text = r.agg(F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("]")).alias("text"))
    value = F.col("value").cast("array<struct<key:int,name:string>>")
    return _documents(spark, text, "json5").select(F.explode(value).alias("x")).select(F.col("x.key").alias("r_regionkey"), F.col("x.name").alias("r_name"))


@query("SELECT r_regionkey, r_name FROM region")
def source_toml(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    entry = F.concat(F.lit("[[region]]\nkey = "), F.col("r_regionkey").cast("string"), F.lit('\nname = "'), "r_name", F.lit('"\n'))
    text = r.agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("text"))
    value = F.try_variant_get("value", "$.region", "array<struct<key:int,name:string>>")
    return _documents(spark, text, "toml").select(F.explode(value).alias("x")).select(F.col("x.key").alias("r_regionkey"), F.col("x.name").alias("r_name"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name FROM region")
def source_ini(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    entry = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(" = "), "r_name", F.lit("\n"))
    text = r.agg(F.concat(F.lit("[region]\n"), F.array_join(F.sort_array(F.collect_list(entry)), "")).alias("text"))
    value = F.try_variant_get("value", "$.region", "map<string,string>")
    return _documents(spark, text, "ini").select(F.explode(value).alias("key", "r_name")).select(F.substring("key", 2, 9).alias("key"), "r_name")


# ---- schema algebra and streams


_OLD, _NEW = "(c_acctbal >= -500 AND length(c_mktsegment) <= 9)", "(c_acctbal >= 0 AND length(c_mktsegment) <= 12)"


@query(f"SELECT *, CASE WHEN lost > 0 THEN 'breaking' ELSE 'compatible' END AS verdict FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE {_OLD}) AS old, count(*) FILTER (WHERE {_NEW}) AS new, count(*) FILTER (WHERE {_OLD} AND NOT {_NEW}) AS lost, count(*) FILTER (WHERE {_NEW} AND NOT {_OLD}) AS gained FROM customer)")
def schema_evolution(spark: SparkSession, d: str) -> DataFrame:
    old = Schema.of(c_acctbal=kind("float") & min_(-500.0), c_mktsegment=kind("string") & len_(max_(9)))
    new = Schema.of(c_acctbal=kind("float") & min_(0.0), c_mktsegment=kind("string") & len_(max_(12)))
    return outcome(table(spark, d, "customer"), old, new)


@query(_counted([("l_discount", "constraint|l_discount >= 0 AND l_discount < 0.1"), ("l_linestatus", "constraint|l_linestatus IN ('O', 'F')"), ("l_quantity", "constraint|l_quantity BETWEEN 1 AND 25"), ("l_returnflag", "constraint|l_returnflag IN ('A', 'N')")], "lineitem"))
def json_schema(spark: SparkSession, d: str) -> DataFrame:
    """The table against its schema after it went out as JSON Schema, through text, and came in again."""
    import json

    from .plans.jsonschema import schema_in, schema_out

    return vet.counts(table(spark, d, "lineitem"), schema_in(json.loads(json.dumps(schema_out(LINEITEM)))))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, 'value' AS path, 'constraint' AS code, count(*) AS n FROM events WHERE NOT coalesce(value >= 10 AND value <= 90, false) GROUP BY 1")
def stream_vet(spark: SparkSession, d: str) -> DataFrame:
    from .streaming import violations_by_window

    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    s = Schema.of(value=kind("float") & min_(10.0) & max_(90.0))
    at = _folder(spark)
    # Each batch's whole result replaces the last one's in the shared folder; nothing comes to the driver.
    put = lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")
    run = violations_by_window(stream, s, "ts").writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return vet_lineitem(spark, d)

