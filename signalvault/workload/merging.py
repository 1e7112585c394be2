"""Store scans and writes, keyed merges and their counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalvault.model import KEY, Store, samples as sample_view
from signalvault.operators import merge as mg
from signalvault.operators import compare as cmp
from signalvault.operators.compare import keys_only_in
from signalvault.operators.convert import to_float32
from signalvault.session import scratch_path
from signalvault.sources import store as st
from signalvault.workload import tables as t
from signalvault.workload.registry import query

_COUNTS = "CAST({} AS BIGINT) AS {}".format


def _merged(strategy: str, spark: SparkSession, sf: str) -> mg.Merge:
    target, sources = t.target_and_stack(t.event_rows(spark, sf))
    return mg.merge_stacked(target, sources, 2, strategy)


# -- resulting content ------------------------------------------------------------

_SURVIVORS = """SELECT o.shot, o.tree, o.signal, o.n_nodes, o.last_id FROM occ o JOIN hold h USING (shot, tree, signal)
 WHERE o.src = {}"""
_SKIP = _SURVIVORS.format("CASE WHEN h.in_target THEN 0 ELSE h.first_src END")
_LAST = _SURVIVORS.format("coalesce(h.last_src, 0)")


@query("merge_skip", f"WITH {t.EVENTS}, {t.HOLDERS} {_SKIP}")
def merge_skip(spark: SparkSession, sf: str) -> DataFrame:
    return t.summary(_merged("skip", spark, sf).store.nodes)


@query("merge_overwrite", f"WITH {t.EVENTS}, {t.HOLDERS} {_LAST}")
def merge_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    return t.summary(_merged("overwrite", spark, sf).store.nodes)


@query("upsert", f"WITH {t.EVENTS}, {t.HOLDERS} {_LAST}")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    return t.summary(_merged("upsert", spark, sf).store.nodes)


def _error_merge(spark: SparkSession, sf: str) -> mg.Merge:
    """Target: source-0 shots from '5' on. The third source shares no key with the others."""
    rows = t.event_rows(spark, sf)
    third = (F.col("src") == 0) & (F.col("shot") < "5")
    rows = rows.withColumns({"src": F.when(third, F.lit(3)).otherwise(F.col("src")),
                             "tree": F.when(third, F.lit("extra")).otherwise(F.col("tree"))})
    return mg.merge_stacked(*t.target_and_stack(rows), 3, "error")


_ERROR = f"""{t.EVENTS},
 k AS (SELECT 0 AS src, shot, tree, signal, event_id FROM ev WHERE src = 0 AND shot >= '5'
   UNION ALL SELECT src, shot, tree, signal, event_id FROM ev WHERE src > 0
   UNION ALL SELECT 3, shot, 'extra', signal, event_id FROM ev WHERE src = 0 AND shot < '5'),
 t0 AS (SELECT * FROM k WHERE src = 0),
 p1 AS (SELECT shot, tree, signal FROM k SEMI JOIN t0 USING (shot, tree, signal) WHERE k.src = 1
   ORDER BY ALL LIMIT 1),
 i1 AS (SELECT * FROM k WHERE src = 1 AND (NOT EXISTS (SELECT 1 FROM p1) OR (shot, tree, signal) < (SELECT (shot, tree, signal) FROM p1))),
 t1 AS (SELECT * FROM t0 UNION ALL SELECT * FROM i1),
 p2 AS (SELECT shot, tree, signal FROM k SEMI JOIN t1 USING (shot, tree, signal) WHERE k.src = 2
   ORDER BY ALL LIMIT 1),
 i2 AS (SELECT * FROM k WHERE src = 2 AND (NOT EXISTS (SELECT 1 FROM p2) OR (shot, tree, signal) < (SELECT (shot, tree, signal) FROM p2))),
 t2 AS (SELECT * FROM t1 UNION ALL SELECT * FROM i2),
 p3 AS (SELECT shot, tree, signal FROM k SEMI JOIN t2 USING (shot, tree, signal) WHERE k.src = 3
   ORDER BY ALL LIMIT 1),
 i3 AS (SELECT * FROM k WHERE src = 3 AND (NOT EXISTS (SELECT 1 FROM p3) OR (shot, tree, signal) < (SELECT (shot, tree, signal) FROM p3))),
 t3 AS (SELECT * FROM t2 UNION ALL SELECT * FROM i3)"""


@query("merge_error", f"""WITH {_ERROR} SELECT shot, tree, signal, count(*) AS n_nodes, max(event_id) AS last_id
 FROM t3 GROUP BY ALL""")
def merge_error(spark: SparkSession, sf: str) -> DataFrame:
    return t.summary(_error_merge(spark, sf).store.nodes)


# -- counters ---------------------------------------------------------------------

_NEW = "(SELECT count(*) FROM hold WHERE NOT in_target)"
_ALL = "(SELECT sum(n_src) FROM hold)"
_TREES = "(SELECT count(*) FROM trees WHERE NOT in_target)"


def _stats_sql(strategy: str, added: str, skipped: str, over: str) -> str:
    return (f"SELECT '{strategy}' AS strategy, " + ", ".join([
        _COUNTS("2", "files_processed"), _COUNTS(_TREES, "trees_added"), _COUNTS(added, "signals_added"),
        _COUNTS(skipped, "signals_skipped"), _COUNTS(over, "signals_overwritten")]))


_REST = f"{_ALL} - {_NEW}"


@query("merge_stats", f"""WITH {t.EVENTS}, {t.HOLDERS} {_stats_sql("skip", _NEW, _REST, "0")}
 UNION ALL {_stats_sql("overwrite", _ALL, "0", _REST)}""")
def merge_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = [_merged(s, spark, sf).stats.withColumn("strategy", F.lit(s)) for s in ("skip", "overwrite")]
    return stats[0].unionByName(stats[1])


@query("upsert_stats", f"""WITH {t.EVENTS}, {t.HOLDERS} {_stats_sql("upsert", _NEW, "0", _REST)}""")
def upsert_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _merged("upsert", spark, sf).stats.withColumn("strategy", F.lit("upsert"))


@query("merge_error_stats", f"""WITH {_ERROR}, g AS (
  SELECT 1 AS src, shot, tree FROM k WHERE src = 1 AND (NOT EXISTS (SELECT 1 FROM p1) OR (shot, tree) <= (SELECT (shot, tree) FROM p1))
  UNION ALL SELECT 2, shot, tree FROM k WHERE src = 2 AND (NOT EXISTS (SELECT 1 FROM p2) OR (shot, tree) <= (SELECT (shot, tree) FROM p2))
  UNION ALL SELECT 3, shot, tree FROM k WHERE src = 3 AND (NOT EXISTS (SELECT 1 FROM p3) OR (shot, tree) <= (SELECT (shot, tree) FROM p3)))
 SELECT CAST(3 - (SELECT count(*) FROM p1) - (SELECT count(*) FROM p2) - (SELECT count(*) FROM p3) AS BIGINT) AS files_processed,
  (SELECT count(*) FROM (SELECT DISTINCT shot, tree FROM g EXCEPT SELECT DISTINCT shot, tree FROM t0)) AS trees_added,
  (SELECT count(*) FROM (SELECT DISTINCT src, shot, tree, signal FROM t3 WHERE src > 0)) AS signals_added,
  CAST(0 AS BIGINT) AS signals_skipped, CAST(0 AS BIGINT) AS signals_overwritten""")
def merge_error_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _error_merge(spark, sf).stats


# -- the parts of a merge ---------------------------------------------------------

@query("merge_precedence", f"""WITH {t.EVENTS}, {t.HOLDERS}
 SELECT shot, tree, signal, CAST(CASE WHEN in_target THEN 0 ELSE first_src END AS INTEGER) AS first_holder,
  CAST(coalesce(last_src, 0) AS INTEGER) AS last_holder, n_src FROM hold""")
def merge_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """First and last holder of every key over target and sources."""
    keys = t.event_rows(spark, sf).select("src", *KEY).distinct()
    return mg.occurrences(keys).select(
        *KEY, F.when(F.col("in_target"), F.lit(0)).otherwise(F.col("first_src")).alias("first_holder"),
        F.coalesce("last_src", F.lit(0)).alias("last_holder"), "n_src")


@query("merge_lookup", f"""WITH {t.EVENTS} SELECT CAST(o.src AS INTEGER) AS src, o.shot, o.tree, o.signal,
 EXISTS (SELECT 1 FROM occ x WHERE x.src = 0 AND x.shot = o.shot AND x.tree = o.tree AND x.signal = o.signal) AS in_target
 FROM occ o WHERE o.src > 0""")
def merge_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """For every source key: does the target hold it?"""
    target, *sources = t.event_stores(spark, sf)
    keys = mg.stacked([s.signal_keys() for s in sources])
    return mg.held_in(keys, target.signal_keys()).select("src", *KEY, "in_target")


@query("sources_union", f"WITH {t.EVENTS} SELECT CAST(src AS INTEGER) AS src, shot, tree, signal FROM occ WHERE src > 0")
def sources_union(spark: SparkSession, sf: str) -> DataFrame:
    _, *sources = t.event_stores(spark, sf)
    return mg.stacked([s.signal_keys() for s in sources])


@query("keys_only_in", f"""WITH {t.EVENTS}, a AS (SELECT * FROM occ WHERE src = 1), b AS (SELECT * FROM occ WHERE src = 2)
 SELECT shot, tree, signal, 'Only in first' AS side FROM a ANTI JOIN b USING (shot, tree, signal)
 UNION ALL SELECT shot, tree, signal, 'Only in second' FROM b ANTI JOIN a USING (shot, tree, signal)""")
def only_in(spark: SparkSession, sf: str) -> DataFrame:
    _, first, second = t.event_stores(spark, sf)
    return keys_only_in(first.signal_keys(), second.signal_keys(), KEY)


@query("keys_equal", f"""WITH {t.EVENTS}, a AS (SELECT DISTINCT shot, tree, signal FROM occ WHERE src = 1),
 b AS (SELECT DISTINCT shot, tree, signal FROM occ WHERE src = 2)
 SELECT shot, tree, bool_and(a.signal IS NOT NULL AND b.signal IS NOT NULL) AS same_keys
 FROM (SELECT *, signal AS s FROM a) a FULL JOIN (SELECT *, signal AS s FROM b) b USING (shot, tree, s) GROUP BY ALL""")
def keys_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Per tree: do two sources list the same signals?"""
    _, first, second = t.event_stores(spark, sf)
    return cmp.keys_equal(first.signal_keys(), second.signal_keys(), KEY, ["shot", "tree"])


@query("name_order", f"""WITH {t.EVENTS}, f AS (SELECT DISTINCT shot, tree, signal FROM occ)
 SELECT shot, min((tree, signal)).tree AS first_tree, min((tree, signal)).signal AS first_signal,
  max((tree, signal)).tree AS last_tree, max((tree, signal)).signal AS last_signal
 FROM (SELECT shot, {{'tree': tree, 'signal': signal}} AS ts FROM f) GROUP BY shot""".replace(
    "(tree, signal)).", "ts)."))
def name_order(spark: SparkSession, sf: str) -> DataFrame:
    """First and last key of every shot in name order, by column and not by joined path."""
    return mg.name_bounds(t.event_rows(spark, sf), ["shot"], ["tree", "signal"])


@query("group_create", f"""WITH {t.EVENTS}, a AS (SELECT DISTINCT shot, tree, signal FROM occ)
 SELECT shot, NULL AS tree, NULL AS signal, 'shot' AS level FROM a GROUP BY shot
 UNION ALL SELECT shot, tree, NULL, 'tree' FROM a GROUP BY shot, tree
 UNION ALL SELECT DISTINCT CAST(c_custkey AS VARCHAR), NULL, NULL, 'shot' FROM customer
   WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT shot FROM a)
 UNION ALL SELECT DISTINCT CAST(c_custkey AS VARCHAR), c_mktsegment, NULL, 'tree' FROM customer
 UNION ALL SELECT shot, tree, signal, 'signal' FROM a""")
def group_create(spark: SparkSession, sf: str) -> DataFrame:
    """Groups after a merge whose last source has empty trees only: they are created."""
    target, first, second = t.event_stores(spark, sf)
    none = F.lit(None).cast("string")
    customers = t.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("shot"), F.col("c_mktsegment").alias("tree"))
    bare = customers.select("shot", "tree", none.alias("signal"), F.lit("tree").alias("level")).unionByName(
        customers.select("shot", none.alias("tree"), none.alias("signal"), F.lit("shot").alias("level"))).distinct()
    hollow = Store(target.nodes.where(F.lit(False)), bare, target.attrs.where(F.lit(False)))
    return mg.merge(target, [first, second, hollow]).store.groups


# -- stores on disk ---------------------------------------------------------------

@query("store_scan", """SELECT CAST(label AS VARCHAR) AS shot, 'vectors' AS tree, 'v' || vec_id AS signal, CAST(2 AS BIGINT) AS n_nodes,
 CAST(2 * len(embedding) AS BIGINT) AS n_values FROM embeddings""")
def store_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of a store in name order, with their leaves and sizes."""
    root = scratch_path(spark, "store")
    st.write_store(t.vector_store(spark, sf), root)
    return st.scan_store(st.read_store(spark, root))


_PER_TREE = """SELECT tree, count(*) AS n_nodes, count(DISTINCT shot) AS n_shots, max(event_id) AS last_id FROM {}
 GROUP BY tree"""


def _per_tree(store: Store) -> DataFrame:
    return store.nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("shot").alias("n_shots"),
        F.max(F.col("node").cast("bigint")).alias("last_id"))


@query("store_write", f"WITH {t.EVENTS} {_PER_TREE.format('ev')}")
def store_write(spark: SparkSession, sf: str) -> DataFrame:
    """A store is written, the other sources are appended, the whole is read back."""
    root = scratch_path(spark, "store")
    target, *sources = t.event_stores(spark, sf)
    st.write_store(target, root)
    for source in sources:
        st.append_store(source, root)
    return _per_tree(st.read_store(spark, root))


@query("merge_append", f"WITH {t.EVENTS}, {t.HOLDERS} {_SKIP}")
def merge_append(spark: SparkSession, sf: str) -> DataFrame:
    """A ``skip`` merge on disk: only what the sources add is written."""
    return t.summary(_merged_on_disk("skip", spark, sf).nodes)


@query("merge_replace", f"WITH {t.EVENTS}, {t.HOLDERS} {_LAST}")
def merge_replace(spark: SparkSession, sf: str) -> DataFrame:
    """An ``overwrite`` merge on disk: the trees the sources name are rewritten."""
    return t.summary(_merged_on_disk("overwrite", spark, sf).nodes)


def _merged_on_disk(strategy: str, spark: SparkSession, sf: str) -> Store:
    root = scratch_path(spark, "store")
    target, sources = t.target_and_stack(t.event_rows(spark, sf))
    st.write_store(target, root)
    st.merge_into(root, sources, 2, strategy)
    return st.read_store(spark, root)


# -- numbers ----------------------------------------------------------------------

@query("to_float32", """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS FLOAT) AS price,
 CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) <> l_extendedprice AS changed, 'f32' AS kind FROM lineitem""")
def narrowed(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.lit("f64").alias("kind"),
        F.array("l_extendedprice").alias("f64"), F.lit(None).cast("array<float>").alias("f32"))
    price = F.get("f32", F.lit(0))
    return to_float32(rows).select(
        "l_orderkey", "l_linenumber", price.alias("price"),
        (price.cast("double") != F.col("l_extendedprice")).alias("changed"), "kind")


@query("convert_store", """SELECT CAST(label AS VARCHAR) AS shot, 'f32' AS kind, 2 * count(*) AS n_nodes,
 CAST(2 * sum(len(embedding)) AS BIGINT) AS n_values FROM embeddings GROUP BY label""")
def convert_store(spark: SparkSession, sf: str) -> DataFrame:
    """A store on disk whose numbers are narrowed and committed."""
    root = scratch_path(spark, "store")
    st.write_store(t.vector_store(spark, sf), root)
    st.convert_in(spark, root)
    return st.read_store(spark, root).nodes.groupBy("shot", "kind").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum(F.size("f32")).cast("bigint").alias("n_values"))


@query("samples", """SELECT CAST(label AS VARCHAR) AS shot, 'v' || vec_id AS signal, i - 1 AS idx, (i - 1) / 2 AS t,
 CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def samples(spark: SparkSession, sf: str) -> DataFrame:
    return sample_view(t.vector_store(spark, sf)).select("shot", "signal", "idx", "t", "v")
