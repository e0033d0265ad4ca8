"""Two trees from a star schema: region / nation / customer / order / line.

The destination holds most of the source's rows (some customers and lines are missing), files that are newer, equal or
older by turns, and supplier folders that the source doesn't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import child_path, rfc3339
from ..plans.store import few

EPOCH = "2024-01-01T00:00:00Z"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, parent, name, kind: str, depth: int, size, ts, k) -> DataFrame:
    return df.select(
        child_path(parent, name).alias("path"), parent.alias("parent_path"), name.alias("name"), F.lit(kind).alias("type"), F.lit(depth).alias("depth"),
        size.cast("long").alias("size"), ts.cast("timestamp").alias("ts"), k.cast("long").alias("k"),
    )


def src_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All source entries, with the time ``ts`` (null: ``EPOCH``) and the number ``k`` they were made from."""
    none, root = F.lit(None), F.lit("/")
    top = spark.range(1).select(root.alias("path"), F.lit("").alias("parent_path"), F.lit("").alias("name"), F.lit("folder").alias("type"), F.lit(0).alias("depth"), none.cast("long").alias("size"), none.cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("k"))
    region = _rows(_t(spark, sf_dir, "region"), root, F.col("r_name"), "folder", 1, none, none, F.col("r_regionkey"))
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.withColumn("pr", F.concat(root, F.col("r_name")))
    nations = _rows(nation, F.col("pr"), F.col("n_name"), "folder", 2, none, none, F.col("n_nationkey"))
    place = few(nation.select(F.col("n_nationkey").alias("nk"), F.concat("pr", F.lit("/"), "n_name").alias("pn")))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(place, F.col("c_nationkey") == F.col("nk"))  # last, so that keys are dealt and not paths

    customer = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    customers = _rows(placed(customer), F.col("pn"), F.concat(F.lit("c"), "c_custkey"), "folder", 3, none, none, F.col("c_custkey"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select("o_orderkey", "o_orderdate", "c_custkey", "c_nationkey")
    pc = F.concat("pn", F.lit("/c"), "c_custkey")
    order_rows = _rows(placed(orders), pc, F.concat(F.lit("o"), "o_orderkey"), "folder", 4, none, F.col("o_orderdate"), F.col("o_orderkey"))
    dealt = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").repartition("l_orderkey")  # once, for the sums and the join
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"), F.max("l_shipdate").alias("mx"))
    lines = placed(lines.join(orders.select("o_orderkey", "c_custkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))).withColumn("po", F.concat(pc, F.lit("/o"), "o_orderkey"))
    line_rows = _rows(lines, F.col("po"), F.concat(F.lit("l"), "l_linenumber"), "file", 5, F.col("q"), F.col("mx"), F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = top
    for part in (region, nations, customers, order_rows, line_rows):
        out = out.unionByName(part)
    return out


def _listing(rows: DataFrame) -> DataFrame:
    mtime = F.coalesce(rfc3339(F.col("ts")), F.lit(EPOCH))
    return rows.select(F.col("path").alias("service_id"), F.col("parent_path").alias("parent_service_id"), "parent_path", "path", "name", "type", "size", mtime.alias("mtime"), "k")


def src_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(src_rows(spark, sf_dir))


def dst_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src_rows(spark, sf_dir).where(~((F.col("depth") == 3) & (F.col("k") % 10 == 0)) & ~((F.col("depth") == 5) & (F.col("k") % 10 == 3)))
    days = F.when((F.col("type") == "file") & (F.col("k") % 3 == 0), 1).when((F.col("type") == "file") & (F.col("k") % 3 == 2), -1).otherwise(0)
    rows = rows.withColumn("ts", (F.col("ts") + F.make_dt_interval(days=days)))
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = nation.select(F.col("n_nationkey").alias("nk"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("pn"))
    supplier = _t(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("nk"))
    folder = _rows(supplier, F.col("pn"), F.concat(F.lit("s"), "s_suppkey"), "folder", 3, F.lit(None), F.lit(None), F.col("s_suppkey"))
    profile = _rows(supplier, F.concat("pn", F.lit("/s"), "s_suppkey"), F.lit("profile"), "file", 4, F.lit(1), F.lit(None), F.col("s_suppkey"))
    return _listing(rows.unionByName(folder).unionByName(profile))


def listing_sql(side: str) -> str:
    """The same listings as DuckDB SQL: ``path, parent_path, name, type, depth, size, mtime, k``."""
    t = lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"
    src = f"""
select '/' path, '' parent_path, '' as name, 'folder' as type, 0 depth, cast(null as bigint) size, cast(null as timestamp) ts, cast(0 as bigint) k
union all select '/'||r_name, '/', r_name, 'folder', 1, null, null, r_regionkey from region
union all select '/'||r_name||'/'||n_name, '/'||r_name, n_name, 'folder', 2, null, null, n_nationkey from nation join region on n_regionkey = r_regionkey
union all select '/'||r_name||'/'||n_name||'/c'||c_custkey, '/'||r_name||'/'||n_name, 'c'||c_custkey, 'folder', 3, null, null, c_custkey
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all select '/'||r_name||'/'||n_name||'/c'||c_custkey||'/o'||o_orderkey, '/'||r_name||'/'||n_name||'/c'||c_custkey, 'o'||o_orderkey, 'folder', 4, null, o_orderdate, o_orderkey
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all select pp||'/l'||l_linenumber, pp, 'l'||l_linenumber, 'file', 5, sz, mx, o_orderkey * 10 + l_linenumber from (
  select '/'||r_name||'/'||n_name||'/c'||c_custkey||'/o'||o_orderkey pp, o_orderkey, l_linenumber, cast(sum(l_quantity) as bigint) sz, max(l_shipdate) mx
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  group by r_name, n_name, c_custkey, o_orderkey, l_linenumber) g"""
    if side == "SRC":
        return f"select * exclude (ts), coalesce({t('ts')}, '{EPOCH}') as mtime from ({src})"
    return f"""select * exclude (ts), coalesce({t('ts')}, '{EPOCH}') as mtime from (
select path, parent_path, name, type, depth, size, case when type = 'file' and k % 3 = 0 then ts + interval 1 day when type = 'file' and k % 3 = 2 then ts - interval 1 day else ts end ts, k
  from ({src}) where not (depth = 3 and k % 10 = 0) and not (depth = 5 and k % 10 = 3)
union all select '/'||r_name||'/'||n_name||'/s'||s_suppkey, '/'||r_name||'/'||n_name, 's'||s_suppkey, 'folder', 3, null, null, s_suppkey
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all select '/'||r_name||'/'||n_name||'/s'||s_suppkey||'/profile', '/'||r_name||'/'||n_name||'/s'||s_suppkey, 'profile', 'file', 4, 1, null, s_suppkey
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
