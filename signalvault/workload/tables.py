"""The given tables seen as shot lists, catalogs, outcomes, ledgers and stores.

Every view exists twice: as a DataFrame, and as the SQL that the oracles share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalvault.model import ATTRS, KEY, NODES, Store, conform, empty, nested_paths, with_ancestors
from signalvault.functions.ordinals import dense_ordinal
from signalvault.plans.acquisition import shots_range
from signalvault.session import cut_lineage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- requests and ledger: orders --------------------------------------------------

def requested(spark: SparkSession, sf: str) -> DataFrame:
    """All order numbers from 0 to the highest one. Only the bound comes to the driver."""
    last = table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    return shots_range(spark, 0, last)


def order_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Order states F and P read as completed and failed."""
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").where(status.isin("F", "P")).select(
        F.col("o_orderkey").cast("string").alias("shot"),
        F.when(status == "F", "completed").otherwise("failed").alias("status"))


def completed(spark: SparkSession, sf: str) -> DataFrame:
    return order_ledger(spark, sf).where(F.col("status") == "completed")


REQUESTED = """req AS (SELECT r AS shot_no, CAST(r AS VARCHAR) AS shot FROM
  (SELECT unnest(range(0, (SELECT max(o_orderkey) + 1 FROM orders))) AS r))"""
ORDER_LEDGER = """led AS (SELECT CAST(o_orderkey AS VARCHAR) AS shot,
  CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'failed' END AS status
  FROM orders WHERE o_orderstatus IN ('F', 'P'))"""
PENDING = f"""{REQUESTED}, {ORDER_LEDGER}, pend AS (SELECT * FROM req r WHERE NOT EXISTS
  (SELECT 1 FROM led l WHERE l.status = 'completed' AND l.shot = r.shot))"""


# -- catalogs: part ---------------------------------------------------------------

def part_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog that grows with the data: one signal per part, in part order."""
    parts = table(spark, sf, "part").select(
        F.col("p_partkey"), F.col("p_brand").alias("tree"), F.col("p_partkey").cast("string").alias("signal"))
    return dense_ordinal(parts, "p_partkey").withColumn("config", F.lit("parts"))


def type_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Two catalogs as large as the domains of brand and type: 150 signals at most."""
    pairs = table(spark, sf, "part").select(F.col("p_brand").alias("tree"), F.col("p_type").alias("signal")).distinct()
    main = F.col("signal").isin("ECONOMY", "SMALL", "MEDIUM", "LARGE")
    numbered = dense_ordinal(pairs.select(F.when(main, 1).otherwise(2).alias("config_no"), "tree", "signal",
                                          F.struct("tree", "signal").alias("place")), "place", within=["config_no"])
    return numbered.select("config_no", F.when(F.col("config_no") == 1, "main").otherwise("rest").alias("config"),
                           F.col("ordinal").cast("bigint").alias("ordinal"), "tree", "signal")


PART_CATALOG = """cat AS (SELECT 'parts' AS config, row_number() OVER (ORDER BY p_partkey) AS ordinal,
  p_brand AS tree, CAST(p_partkey AS VARCHAR) AS signal, p_partkey FROM part),
 chk AS (SELECT *, (ordinal - 1) // 100 + 1 AS chunk FROM cat)"""
TYPE_CATALOG = """pairs AS (SELECT DISTINCT p_brand AS tree, p_type AS signal,
   CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'MEDIUM', 'LARGE') THEN 1 ELSE 2 END AS config_no FROM part),
 cat AS (SELECT config_no, CASE config_no WHEN 1 THEN 'main' ELSE 'rest' END AS config,
   row_number() OVER (PARTITION BY config_no ORDER BY tree, signal) AS ordinal, tree, signal FROM pairs)"""


# -- text lines: documents --------------------------------------------------------

def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def list_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as shot lists: some lines turned into comments and blanks."""
    def line(x: Column, i: Column) -> Column:
        return (F.when((i + 1) % 5 == 0, F.concat(F.lit("  # "), x))
                .when((i + 1) % 7 == 0, F.lit("")).otherwise(x))

    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(F.transform(_lines(F.col("text")), line), "\n").alias("text"))


def catalog_texts(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """Documents as catalogs: a line whose length divides by 7 is a header, one whose
    length divides by 5 is badly indented, the others are items; then a server line."""
    def line(x: Column) -> Column:
        n = F.length(x)
        return (F.when(n % 7 == 0, F.concat(F.lit("  T"), n.cast("string"), F.lit(":")))
                .when(n % 5 == 0, F.concat(F.lit("  - "), x))
                .otherwise(F.concat(F.lit("    - "), x)))

    body = F.array_join(F.transform(_lines(F.col("text")), line), "\n")
    return table(spark, sf, "documents").select(
        *keep, "doc_id", F.concat(F.lit("trees:\n"), body, F.lit("\n\nserver:  "), "source",
                           F.lit(".host:80  \n")).alias("text"))


DOC_LINES = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"""
LONG_CATALOG_LINES = """ln AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
 marked AS (SELECT source, doc_id, n, line, length(line) % 7 <> 0 AND length(line) % 5 <> 0 AS is_item,
   last_value(CASE WHEN length(line) % 7 = 0 THEN 'T' || length(line) END IGNORE NULLS)
     OVER (PARTITION BY source ORDER BY doc_id, n) AS tree FROM ln)"""
LIST_LINES = f"""{DOC_LINES}, lst AS (SELECT doc_id, n, CASE WHEN n % 5 = 0 THEN '  # ' || line
  WHEN n % 7 = 0 THEN '' ELSE line END AS line FROM ln)"""
CATALOG_LINES = f"""{DOC_LINES}, marked AS (SELECT doc_id, n, line,
   length(line) % 7 = 0 AS is_head, length(line) % 7 <> 0 AND length(line) % 5 <> 0 AS is_item,
   last_value(CASE WHEN length(line) % 7 = 0 THEN 'T' || length(line) END IGNORE NULLS)
     OVER (PARTITION BY doc_id ORDER BY n) AS tree FROM ln),
 parsed AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS ordinal, tree,
   trim(line) AS signal FROM marked WHERE is_item AND tree IS NOT NULL)"""


# -- rename mapping lines: customer -----------------------------------------------

def mapping_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One mapping file per market segment would hide the row order, so each customer is a file."""
    key = F.col("c_custkey")
    line = (
        F.when(key % 6 == 0, F.lit("   "))
        .when(key % 6 == 1, F.concat(F.lit(" # "), "c_name", F.lit(" x")))
        .when(key % 6 == 2, F.col("c_name"))
        .when(key % 6 == 3, F.concat("c_name", F.lit(" to "), "c_mktsegment"))
        .otherwise(F.concat(F.lit("\t"), "c_name", F.lit(" \t "), "c_mktsegment", F.lit("  ")))
    )
    return table(spark, sf, "customer").select("c_custkey", line.alias("text"))


# -- chunk outcomes: lineitem -----------------------------------------------------

def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("shot"), F.col("l_linestatus").alias("config"),
        (F.col("l_returnflag") == "R").cast("int").alias("exit_code"))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Shots with a non-empty output: orders above a price."""
    return table(spark, sf, "orders").where(F.col("o_totalprice") > 50000).select(
        F.col("o_orderkey").cast("string").alias("shot"))


OUTCOMES = """outc AS (SELECT CAST(l_orderkey AS VARCHAR) AS shot, l_linestatus AS config,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS exit_code FROM lineitem),
 outp AS (SELECT CAST(o_orderkey AS VARCHAR) AS shot FROM orders WHERE o_totalprice > 50000)"""


# -- stores: events ---------------------------------------------------------------

def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scalar leaves of (src, shot, tree, signal); src 0 is the target."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return table(spark, sf, "events").select(
        ((F.dayofmonth("ts") - 1) % 3).alias("src"), F.col("user_id").cast("string").alias("shot"),
        F.col("event_type").alias("tree"), F.concat(F.lit("K"), (k % 8).cast("string")).alias("signal"),
        "event_id", "value", "user_id", (k % 8).alias("k"))


def as_nodes(rows: DataFrame, *more: str) -> DataFrame:
    """Leaf rows as nodes, each event a scalar; ``more`` columns are kept in addition."""
    nodes = rows.withColumns({
        "node": F.col("event_id").cast("string"), "seg": F.lit(0), "kind": F.lit("f64"),
        "shape": F.array().cast("array<bigint>"), "f64": F.array("value")})
    return conform(nodes, ", ".join([NODES, *[f"{c} int" for c in more]]))


def as_store(rows: DataFrame) -> Store:
    """Leaf rows -> store. The groups need the key columns only; as in any store they
    are a written table, because every operator reads them several times."""
    return Store(as_nodes(rows), cut_lineage(with_ancestors(rows)), empty(rows.sparkSession, ATTRS))


def as_stack(rows: DataFrame) -> Store:
    """Leaf rows with ``src`` -> the sources as one store."""
    return Store(as_nodes(rows, "src"), cut_lineage(with_ancestors(rows, "src")),
                 empty(rows.sparkSession, ATTRS + ", src int"))


def as_nested_store(rows: DataFrame, bare: Column) -> Store:
    """Leaf rows, two groups below their signals, as a store; each signal has an empty group ``e/f`` besides, but only
    ``e`` where ``bare`` holds."""
    store = as_store(rows)
    leaves = as_nodes(rows).withColumn("node", F.concat(inner_of("node"), F.lit("/"), "node"))
    hollow = rows.select(*KEY, F.when(bare, "e").otherwise("e/f").alias("of")).distinct()
    groups = rows.select(*KEY, inner_of("event_id").alias("of")).distinct().unionByName(hollow)
    return Store(leaves, store.groups, store.attrs, cut_lineage(nested_paths(groups, "of")))


def inner_of(node: str) -> Column:
    """The groups that the leaf of an event lies in."""
    event = F.col(node).cast("bigint")
    return F.concat(F.lit("g"), (event % 3).cast("string"), F.lit("/h"), (event % 2).cast("string"))


NESTED = """inner_groups AS (SELECT DISTINCT shot, tree, signal, user_id, k, unnest(['g' || (event_id % 3), 'g' || (event_id % 3) || '/h' || (event_id % 2), 'e', 'e/f']) AS path FROM ev)"""


def event_stores(spark: SparkSession, sf: str) -> list[Store]:
    """Target and two sources, each on its own."""
    rows = event_rows(spark, sf)
    return [as_store(rows.where(F.col("src") == i)) for i in range(3)]


def target_and_stack(rows: DataFrame) -> tuple[Store, Store]:
    """Leaf rows with ``src`` -> the target (0) and the sources together."""
    return as_store(rows.where(F.col("src") == 0)), as_stack(rows.where(F.col("src") > 0))


EVENTS = """ev AS (SELECT (day(ts) - 1) % 3 AS src, CAST(user_id AS VARCHAR) AS shot, event_type AS tree,
  'K' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 8) AS signal,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 8 AS k, event_id, value, user_id FROM events),
 occ AS (SELECT src, shot, tree, signal, count(*) AS n_nodes, max(event_id) AS last_id FROM ev
   GROUP BY ALL)"""
HOLDERS = """hold AS (SELECT shot, tree, signal, min(src) = 0 AS in_target,
   min(CASE WHEN src > 0 THEN src END) AS first_src, max(CASE WHEN src > 0 THEN src END) AS last_src,
   count(CASE WHEN src > 0 THEN 1 END) AS n_src FROM occ GROUP BY ALL),
 trees AS (SELECT shot, tree, min(src) = 0 AS in_target FROM occ GROUP BY ALL)"""


def summary(nodes: DataFrame) -> DataFrame:
    """Content proxies per signal: number of leaves and the highest event."""
    return nodes.groupBy("shot", "tree", "signal").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max(F.col("node").cast("bigint")).alias("last_id"))


# -- stores: embeddings -----------------------------------------------------------

def vector_store(spark: SparkSession, sf: str) -> Store:
    """Vectors as signals: ``data`` is the vector, ``dim0`` the places; shots are the labels."""
    base = table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("shot"), F.lit("vectors").alias("tree"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("signal"), "embedding")
    data = base.select("shot", "tree", "signal", F.lit("data").alias("node"), F.lit(0).alias("seg"),
                       F.lit("f32").alias("kind"), F.array(F.size("embedding")).alias("shape"),
                       F.col("embedding").alias("f32"))
    places = F.transform("embedding", lambda x, i: i.cast("double") / 2)
    dim0 = base.select("shot", "tree", "signal", F.lit("dim0").alias("node"), F.lit(0).alias("seg"),
                       F.lit("f64").alias("kind"), F.array(F.size("embedding")).alias("shape"),
                       places.alias("f64"))
    nodes = conform(data, NODES).unionByName(conform(dim0, NODES))
    return Store(nodes, with_ancestors(base), empty(spark, ATTRS))
