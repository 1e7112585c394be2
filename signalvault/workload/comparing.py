"""Comparison of subtrees, renames and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalvault.functions.ordinals import dense_ordinal
from signalvault.model import NODES, Store, conform, split_segments
from signalvault.operators import compare as cmp
from signalvault.operators import rename as rn
from signalvault.session import scratch_path
from signalvault.sources import store as st
from signalvault.workload import tables as t
from signalvault.workload.registry import query

# -- leaves: vectors against altered copies ---------------------------------------
# Case vec_id % 8: 0 same, 1 within tolerance, 2 beyond it, 3 NaN in both, 4 NaN in the
# first, 5 shorter, 6 absent in the second, 7 infinity in the second.


def _vectors(spark: SparkSession, sf: str, side: str) -> DataFrame:
    case = F.col("vec_id") % 8
    values = F.transform("embedding", lambda x: x.cast("double"))

    def at_first(number: float) -> Column:
        return F.concat(F.array(F.lit(number)), F.slice(values, 2, F.size(values)))

    nan, inf = float("nan"), float("inf")
    if side == "first":
        data = F.when(case.isin(3, 4), at_first(nan)).otherwise(values)
    else:
        data = (F.when(case == 1, F.transform(values, lambda x: x * F.lit(1.0 + 1e-12)))
                .when(case == 2, F.transform(values, lambda x: x + F.lit(1e-6)))
                .when(case == 3, at_first(nan)).when(case == 7, at_first(inf))
                .when(case == 5, F.slice(values, 1, F.size(values) - 1)).otherwise(values))
    rows = t.table(spark, sf, "embeddings")
    if side == "second":
        rows = rows.where(case != 6)
    return conform(rows.select(
        (F.col("vec_id") % 40).alias("unit"), "vec_id", F.lit("data").alias("node"), F.lit(0).alias("seg"),
        F.lit("f64").alias("kind"), data.alias("f64")).withColumn("shape", F.array(F.size("f64"))),
        "unit bigint, vec_id bigint, " + NODES.split("signal string, ")[1])


_VECTOR_SQL = """e AS (SELECT vec_id, vec_id % 8 AS m, vec_id % 40 AS unit, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 el AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM e),
 a AS (SELECT unit, vec_id, i, CASE WHEN m IN (3, 4) AND i = 1 THEN CAST('nan' AS DOUBLE) ELSE v[i] END AS x FROM el),
 b AS (SELECT unit, vec_id, i, CASE WHEN m = 1 THEN v[i] * 1.000000000001 WHEN m = 2 THEN v[i] + 0.000001
   WHEN m = 3 AND i = 1 THEN CAST('nan' AS DOUBLE) WHEN m = 7 AND i = 1 THEN CAST('inf' AS DOUBLE) ELSE v[i] END AS y
   FROM el WHERE m <> 6 AND NOT (m = 5 AND i = len(v))),
 pt AS (SELECT unit, vec_id, x, y, x IS NULL OR y IS NULL AS odd,
   coalesce(isnan(x), FALSE) <> coalesce(isnan(y), FALSE) AS nan_odd,
   CASE WHEN x IS NULL OR y IS NULL THEN FALSE WHEN isnan(x) OR isnan(y) THEN isnan(x) AND isnan(y)
     WHEN isinf(x) OR isinf(y) THEN x = y ELSE abs(x - y) <= 1e-9 + 1e-9 * abs(y) END AS ok
   FROM a FULL JOIN b USING (unit, vec_id, i)),
 leaf AS (SELECT unit, vec_id, CASE WHEN count(y) = 0 THEN 'Only in first' WHEN bool_or(odd) THEN 'Shape mismatch'
   WHEN bool_and(ok) THEN 'equal' WHEN bool_or(nan_odd) THEN 'NaN positions differ' ELSE 'Data values differ' END AS result
   FROM pt GROUP BY ALL)"""


def _leaf_side(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _vectors(spark, sf, name).withColumn("path", F.concat_ws("/", "vec_id", "node"))


def _leaf_differences(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.leaf_differences(_leaf_side(spark, sf, "first"), _leaf_side(spark, sf, "second"), ["unit"])


@query("compare_leaf", f"WITH {_VECTOR_SQL} SELECT unit, vec_id || '/data' AS path, result AS difference FROM leaf WHERE result <> 'equal'")
def compare_leaf(spark: SparkSession, sf: str) -> DataFrame:
    return _leaf_differences(spark, sf)


@query("compare_recut", f"WITH {_VECTOR_SQL} SELECT unit, vec_id || '/data' AS path, result AS difference FROM leaf WHERE result <> 'equal'")
def compare_recut(spark: SparkSession, sf: str) -> DataFrame:
    """The same leaves, cut into segments of 3 values on one side and of 5 on the other."""
    sides = [split_segments(_leaf_side(spark, sf, name), "f64", n) for name, n in (("first", 3), ("second", 5))]
    return cmp.leaf_differences(*sides, ["unit"], elements=16)


@query("compare_subtrees", f"""WITH {_VECTOR_SQL} SELECT unit, count(*) FILTER (result <> 'equal') AS n_differences,
 bool_and(result = 'equal') AS is_equal FROM leaf GROUP BY unit""")
def compare_subtrees(spark: SparkSession, sf: str) -> DataFrame:
    units = _vectors(spark, sf, "first").select("unit").distinct()
    return cmp.verdicts(units, _leaf_differences(spark, sf), ["unit"])


@query("compare_verdict", f"""WITH {_VECTOR_SQL} SELECT is_equal, count(*) AS n_units, CAST(sum(n) AS BIGINT) AS n_differences FROM
 (SELECT unit, bool_and(result = 'equal') AS is_equal, count(*) FILTER (result <> 'equal') AS n FROM leaf GROUP BY unit) GROUP BY is_equal""")
def compare_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """How many units are equal and how many differ."""
    units = _vectors(spark, sf, "first").select("unit").distinct()
    return cmp.verdicts(units, _leaf_differences(spark, sf), ["unit"]).groupBy("is_equal").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("n_differences").alias("n_differences"))


@query("first_differences", f"""WITH {_VECTOR_SQL}, d AS (SELECT unit, vec_id || '/data: ' || result AS txt,
   row_number() OVER (PARTITION BY unit ORDER BY vec_id || '/data: ' || result) AS r,
   count(*) OVER (PARTITION BY unit) AS n FROM leaf WHERE result <> 'equal')
 SELECT unit, string_agg(txt, '; ' ORDER BY txt) AS shown, greatest(max(n) - 5, 0) AS n_more FROM d WHERE r <= 5 GROUP BY unit""")
def first_differences(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.first_differences(_leaf_differences(spark, sf), ["unit"]).withColumn(
        "shown", F.array_join("shown", "; "))


@query("compare_align", f"""WITH {t.EVENTS}, a AS (SELECT shot, event_id FROM ev WHERE signal <> 'K0'),
 b AS (SELECT shot, event_id FROM ev WHERE signal <> 'K1')
 SELECT shot, count(*) FILTER (a.e IS NOT NULL AND b.e IS NOT NULL) AS both_sides,
  count(*) FILTER (b.e IS NULL) AS only_first, count(*) FILTER (a.e IS NULL) AS only_second
 FROM (SELECT *, event_id AS e FROM a) a FULL JOIN (SELECT *, event_id AS e FROM b) b USING (shot, event_id) GROUP BY shot""")
def compare_align(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment of two subtrees by relative path."""
    nodes = t.as_nodes(t.event_rows(spark, sf)).withColumn(
        "path", F.concat_ws("/", "tree", "signal", "node"))
    first, second = (nodes.where(F.col("signal") != s) for s in ("K0", "K1"))
    aligned = cmp.align(first, second, ["shot", "path", "seg"], ["kind"])
    return aligned.groupBy("shot").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"),
        F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


# -- attributes: document facts ---------------------------------------------------
# Case doc_id % 5 of the second side: 0 same, 1 language in capitals, 2 source absent,
# 3 length as a floating number, 4 language as bytes.


def _facts(spark: SparkSession, sf: str, side: str) -> DataFrame:
    case = F.col("doc_id") % 5
    second = F.lit(side == "second")
    lang = F.when(second & (case == 1), F.upper("lang")).otherwise(F.col("lang"))
    as_bytes = second & (case == 4)
    as_float = second & (case == 3)

    def fact(name: str, kind: Column, **filled: Column) -> Column:
        columns = {"f64": "array<double>", "i64": "array<bigint>", "str": "array<string>", "bin": "binary"}
        return F.struct(
            F.lit(name).alias("name"), kind.alias("kind"), F.lit(False).alias("is_array"),
            *[filled.get(c, F.lit(None)).cast(ty).alias(c) for c, ty in columns.items()])

    facts = F.array(
        fact("lang", F.when(as_bytes, "bin").otherwise("str"),
             str=F.when(~as_bytes, F.array(lang)), bin=F.when(as_bytes, F.encode(lang, "UTF-8"))),
        fact("source", F.lit("str"), str=F.array("source")),
        fact("n_chars", F.when(as_float, "f64").otherwise("i64"),
             i64=F.when(~as_float, F.array("n_chars")), f64=F.when(as_float, F.array(F.col("n_chars").cast("double")))))
    rows = t.table(spark, sf, "documents").select("doc_id", F.lit("").alias("path"), F.explode(facts).alias("f"))
    rows = rows.select("doc_id", "path", "f.*")
    return rows.where(~((F.col("doc_id") % 5 == 2) & (F.col("name") == "source"))) if side == "second" else rows


@query("compare_attrs", """SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'Attribute differs: lang' ELSE 'Attribute keys differ' END AS difference
 FROM documents WHERE doc_id % 5 = 2 OR (doc_id % 5 = 1 AND upper(lang) <> lang)""")
def compare_attrs(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.attr_differences(_facts(spark, sf, "first"), _facts(spark, sf, "second"), ["doc_id"]).drop("path")


# -- renames: event names against built copies ------------------------------------
# Case m of the copy under the new name: 0 absent, 1 identical, 2 within tolerance, 3 off by one.


def _copies(rows: DataFrame, case: Column, column: str, new: Column) -> DataFrame:
    m = case % 4
    value = (F.when(m == 1, F.col("value")).when(m == 2, F.col("value") * F.lit(1.0 + 1e-12))
             .otherwise(F.col("value") + 1))
    return rows.where(m != 0).withColumns({"value": value, column: new})


def _copied_sql(case: str, scope: str, rows: str = "ev") -> str:
    """Verdict and number of differences per scope, from an alignment of values."""
    return f"""src AS (SELECT *, ({case}) % 4 AS m FROM {rows}),
 b AS (SELECT *, CASE m WHEN 1 THEN value WHEN 2 THEN value * 1.000000000001 ELSE value + 1 END AS y FROM src WHERE m <> 0),
 u AS (SELECT {scope}, b.event_id IS NOT NULL AS there, abs(src.value - y) <= 1e-9 + 1e-9 * abs(y) AS ok
   FROM src LEFT JOIN (SELECT event_id, y FROM b) b USING (event_id)),
 verdict AS (SELECT {scope}, CASE WHEN NOT bool_or(there) THEN 'renamed' WHEN bool_and(ok) THEN 'deduplicated' ELSE 'conflict' END AS verdict,
   count(*) FILTER (there AND NOT ok) AS n_differences FROM u GROUP BY ALL)"""


_CLICKS = "(SELECT * FROM ev WHERE tree = 'click')"
_TREE_SQL = f"{t.EVENTS}, {_copied_sql('user_id', 'shot', _CLICKS)}"


def _tree_store(spark: SparkSession, sf: str) -> Store:
    rows = t.event_rows(spark, sf)
    copies = _copies(rows.where(F.col("tree") == "click"), F.col("user_id"), "tree", F.lit("click2"))
    return t.as_store(rows.unionByName(copies))


@query("rename_tree", f"WITH {_TREE_SQL} SELECT shot, 'click' AS old_name, 'click2' AS new_name, verdict, n_differences FROM verdict")
def rename_tree(spark: SparkSession, sf: str) -> DataFrame:
    return rn.rename(_tree_store(spark, sf), "click", "click2").verdicts.select(
        "shot", "old_name", "new_name", "verdict", "n_differences")


@query("dry_run", f"""WITH {_TREE_SQL} SELECT 'dry' AS run, verdict, count(*) AS n_groups FROM verdict GROUP BY verdict""")
def dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts only; the store that comes back is the one that went in."""
    store = _tree_store(spark, sf)
    result = rn.rename(store, "click", "click2", dry_run=True)
    assert result.store is store
    return result.verdicts.groupBy(F.lit("dry").alias("run"), "verdict").agg(F.count(F.lit(1)).alias("n_groups"))


@query("rename_stats", f"""WITH {_TREE_SQL} SELECT count(*) FILTER (verdict <> 'conflict') AS renamed,
 count(*) FILTER (verdict = 'conflict') AS conflicts FROM verdict""")
def rename_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rn.rename_stats(rn.rename(_tree_store(spark, sf), "click", "click2"))


_AFTER_TREE = f"""{_TREE_SQL}, allrows AS (SELECT shot, tree, event_id FROM ev
   UNION ALL SELECT shot, 'click2', event_id FROM b),
 after AS (SELECT r.shot, CASE WHEN r.tree = 'click' AND v.verdict = 'renamed' THEN 'click2' ELSE r.tree END AS tree, event_id
   FROM allrows r LEFT JOIN verdict v USING (shot) WHERE NOT (r.tree = 'click' AND v.verdict = 'deduplicated'))"""


@query("store_replace", f"""WITH {_AFTER_TREE} SELECT shot, tree, count(*) AS n_nodes, max(event_id) AS last_id
 FROM after GROUP BY ALL""")
def store_replace(spark: SparkSession, sf: str) -> DataFrame:
    """A rename committed to disk: the two trees it touches are rewritten, the rest stays."""
    root = scratch_path(spark, "store")
    st.write_store(_tree_store(spark, sf), root)
    renamed = rn.rename(st.read_store(spark, root), "click", "click2").store
    st.replace_trees(renamed, root, ["click", "click2"])
    return st.read_store(spark, root).nodes.groupBy("shot", "tree").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max(F.col("node").cast("bigint")).alias("last_id"))


# -- stores on disk: digests, nested groups, changes in buckets ---------------------
# Case user_id % 3 of the second store: 0 same, 1 within tolerance, 2 off by one in signal K0.


@query("compare_stored", f"""WITH {t.EVENTS} SELECT shot, tree, count(*) FILTER (user_id % 3 = 2 AND signal = 'K0') AS n_differences,
 count(*) FILTER (user_id % 3 = 2 AND signal = 'K0') = 0 AS is_equal FROM ev GROUP BY shot, tree""")
def compare_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Two written stores are compared by the digests of their trees, then signals, then leaves."""
    case = F.col("user_id") % 3
    value = F.when(case == 1, F.col("value") * F.lit(1.0 + 1e-12)).when((case == 2) & (F.col("signal") == "K0"), F.col("value") + 1).otherwise(F.col("value"))
    rows, stores = t.event_rows(spark, sf), []
    for side in (rows, rows.withColumn("value", value)):
        root = scratch_path(spark, "store")
        st.write_store(t.as_store(side), root)
        stores.append(st.read_store(spark, root))
    return cmp.compare_stores(*stores, "tree")[0]


@query("keys_nested", f"""WITH {t.EVENTS}, {t.NESTED} SELECT shot, tree, signal, 'e' AS parent, 'e/f' AS path, 'Only in first' AS side
 FROM inner_groups WHERE path = 'e/f' AND k % 2 = 1""")
def keys_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Groups below signals that one of two stores lacks, two levels down."""
    rows = t.event_rows(spark, sf)
    first, second = (t.as_nested_store(rows, bare) for bare in (F.lit(False), F.col("k") % 2 == 1))
    return cmp.keys_only_in(first.paths, second.paths, ["shot", "tree", "signal", "parent", "path"])


_NESTED_SQL = f"""{t.EVENTS}, {t.NESTED}, verdict AS (SELECT shot, bool_or(k % 2 = 1) AS odd, count(DISTINCT signal) FILTER (k % 2 = 1) AS n
   FROM ev WHERE tree = 'click' GROUP BY shot),
 rowsafter AS (SELECT shot, tree, signal, NULL AS path, event_id, FALSE AS copy FROM ev
   UNION ALL SELECT shot, tree, signal, path, NULL, FALSE FROM inner_groups
   UNION ALL SELECT shot, 'click2', signal, NULL, event_id, TRUE FROM ev WHERE tree = 'click'
   UNION ALL SELECT shot, 'click2', signal, path, NULL, TRUE FROM inner_groups WHERE tree = 'click' AND NOT (path = 'e/f' AND k % 2 = 1))"""


def _nested_store(spark: SparkSession, sf: str) -> Store:
    """Trees ``click`` and an equal ``click2``, but that its signals of odd number lack an empty group two levels down."""
    rows = t.event_rows(spark, sf)
    rows = rows.unionByName(rows.where(F.col("tree") == "click").withColumn("tree", F.lit("click2")))
    return t.as_nested_store(rows, (F.col("tree") == "click2") & (F.col("k") % 2 == 1))


@query("compare_nested", f"""WITH {_NESTED_SQL} SELECT shot, CASE WHEN odd THEN 'conflict' ELSE 'deduplicated' END AS verdict,
 n AS n_differences FROM verdict""")
def compare_nested(spark: SparkSession, sf: str) -> DataFrame:
    """A tree is not dropped for one that lacks an empty group two levels below a signal."""
    return rn.rename(_nested_store(spark, sf), "click", "click2").verdicts.select("shot", "verdict", "n_differences")


@query("rename_nested", f"""WITH {_NESTED_SQL} SELECT shot, tree, count(event_id) AS n_nodes, count(path) AS n_groups
 FROM rowsafter LEFT JOIN verdict USING (shot) WHERE tree <> 'click' OR odd GROUP BY shot, tree""")
def rename_nested(spark: SparkSession, sf: str) -> DataFrame:
    """The same rename on a written store: groups below signals go with their tree."""
    root = scratch_path(spark, "store")
    st.write_store(_nested_store(spark, sf), root)
    st.rename_in(spark, root, "click", "click2")
    after = st.read_store(spark, root)
    nodes = after.nodes.groupBy("shot", "tree").agg(F.count(F.lit(1)).alias("n_nodes"))
    return nodes.join(after.paths.groupBy("shot", "tree").agg(F.count(F.lit(1)).alias("n_groups")), ["shot", "tree"])


@query("store_changes", f"""WITH {t.EVENTS}, {t.HOLDERS},
 kept AS (SELECT shot, tree, signal, CASE WHEN n_src > 0 THEN last_src ELSE 0 END AS src FROM hold)
 SELECT CASE shot WHEN '5' THEN 'five' ELSE shot END AS shot, CASE tree WHEN 'click' THEN 'tap' ELSE tree END AS tree,
  CASE WHEN shot = '3' AND tree = 'view' AND signal = 'K1' THEN 'first' ELSE signal END AS signal, n_nodes, last_id
 FROM occ JOIN kept USING (shot, tree, signal, src)""")
def store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Merges and renames that delete keys and add rows, one of the buckets folded in between; no tree is rewritten."""
    root = scratch_path(spark, "store")
    target, sources = t.target_and_stack(t.event_rows(spark, sf))
    st.write_store(target, root)
    st.merge_into(root, sources, 2, "overwrite")
    st.rename_in(spark, root, "5", "five", level="shot")
    st.fold_deletes(spark, root)
    st.rename_in(spark, root, "click", "tap")
    st.rename_in(spark, root, "K1", "first", level="signal", shot="3", tree="view")
    return t.summary(st.read_store(spark, root).nodes)


@query("scope_filter", f"""WITH {_TREE_SQL} SELECT * FROM (SELECT shot, verdict FROM verdict WHERE shot = '3')
 UNION ALL SELECT 'no shot', 'not_found'""")
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The rename restricted to one shot, and to one that does not exist."""
    store = _tree_store(spark, sf)
    done = [rn.rename(store, "click", "click2", shot=s).verdicts.select("shot", "verdict") for s in ("3", "no shot")]
    return done[0].unionByName(done[1])


@query("collision_join", f"""WITH {t.EVENTS} SELECT DISTINCT a.shot, 'click' AS old_name, 'view' AS new_name
 FROM ev a JOIN ev b ON a.shot = b.shot AND a.tree = 'click' AND b.tree = 'view'""")
def collision_join(spark: SparkSession, sf: str) -> DataFrame:
    """Shots that hold both names."""
    labels = rn.labels_of(t.as_store(t.event_rows(spark, sf)), "tree")
    lines = _lines(spark, ("click", "view"))
    return rn.candidates(labels, lines, "tree").where(F.col("new_origin").isNotNull()).select(
        "shot", "old_name", "new_name")


@query("mapping_join", f"""WITH {t.EVENTS}, m(line_no, old_name, new_name) AS (VALUES (1, 'click', 'c'), (2, 'view', 'v'), (3, 'nothing', 'n'))
 SELECT DISTINCT CAST(line_no AS BIGINT) AS line_no, shot, old_name, new_name FROM m JOIN ev ON tree = old_name""")
def mapping_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = rn.labels_of(t.as_store(t.event_rows(spark, sf)), "tree")
    lines = _lines(spark, ("click", "c"), ("view", "v"), ("nothing", "n"))
    return rn.candidates(labels, lines, "tree").select("line_no", "shot", "old_name", "new_name")


def _lines(spark: SparkSession, *pairs: tuple[str, str]) -> DataFrame:
    """A rename mapping as the text it would be read from."""
    from signalvault.sources.text import mapping_lines, numbered_lines

    text = "# old new\n" + "\n".join(f"{a} {b}" for a, b in pairs)
    good, _ = mapping_lines(numbered_lines(spark.range(1).select(F.lit(text).alias("text"))))
    return rn.mapping_of(good.withColumn("line_no", F.col("line_no") - 1))


@query("noop_rename", f"""WITH {t.EVENTS} SELECT CAST(1 AS BIGINT) AS line_no, NULL AS shot, 'same_name' AS verdict
 UNION ALL SELECT DISTINCT CAST(2 AS BIGINT), shot, 'renamed' FROM ev WHERE tree = 'view'""")
def noop_rename(spark: SparkSession, sf: str) -> DataFrame:
    store = t.as_store(t.event_rows(spark, sf))
    result = rn.rename_batch(store, _lines(spark, ("click", "click"), ("view", "sight")))
    return result.verdicts.select("line_no", "shot", "verdict")


@query("rename_batch", f"""WITH {_AFTER_TREE},
 chained AS (SELECT shot, CASE tree WHEN 'click2' THEN 'click3' WHEN 'view' THEN 'sight' ELSE tree END AS tree, event_id FROM after)
 SELECT shot, tree, count(*) AS n_nodes, max(event_id) AS last_id FROM chained GROUP BY ALL""")
def rename_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping with a chain, an independent line and an unknown name."""
    mapping = _lines(spark, ("click", "click2"), ("view", "sight"), ("click2", "click3"), ("nothing", "n"))
    return rn.rename_batch(_tree_store(spark, sf), mapping).store.nodes.groupBy("shot", "tree").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max(F.col("node").cast("bigint")).alias("last_id"))


@query("rename_file", f"""WITH {_AFTER_TREE},
 chained AS (SELECT shot, CASE tree WHEN 'click2' THEN 'click3' WHEN 'view' THEN 'sight' ELSE tree END AS tree, event_id FROM after)
 SELECT shot, tree, count(*) AS n_nodes, max(event_id) AS last_id, CAST(2 AS BIGINT) AS n_rejected FROM chained GROUP BY ALL""")
def rename_file(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping file with comments and bad lines, applied to a store on disk."""
    root, mapping = scratch_path(spark, "store"), scratch_path(spark, "mapping")
    st.write_store(_tree_store(spark, sf), root)
    text = "# old new\rclick click2\r\nview sight\n\nonlyone\na b c\nclick2 click3\nnothing n"
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(mapping)
    _, rejected, _ = st.rename_file_in(spark, root, mapping)
    lost = rejected.agg(F.count(F.lit(1)))
    return st.read_store(spark, root).nodes.groupBy("shot", "tree").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max(F.col("node").cast("bigint")).alias("last_id"),
    ).withColumn("n_rejected", lost.scalar())


@query("rename_shot", f"""WITH {t.EVENTS}, {_copied_sql('user_id', 'shot')}
 SELECT shot AS old_name, shot || 'n' AS new_name, verdict, n_differences FROM verdict""")
def rename_shot(spark: SparkSession, sf: str) -> DataFrame:
    """Every shot gets a new name; the mapping is as long as the list of shots."""
    rows = t.event_rows(spark, sf)
    new = F.concat("shot", F.lit("n"))
    store = t.as_store(rows.unionByName(_copies(rows, F.col("user_id"), "shot", new)))
    mapping = rows.select("user_id", "shot").distinct().select(
        F.col("user_id").alias("line_no"), F.col("shot").alias("old_name"), new.alias("new_name"))
    return rn.rename_batch(store, mapping, "shot").verdicts.select(
        "old_name", "new_name", "verdict", "n_differences")


@query("rename_signal", f"""WITH {t.EVENTS}, {_copied_sql('user_id + k', 'shot, tree, signal')}
 SELECT shot, tree, signal AS old_name, signal || 'n' AS new_name, verdict, n_differences FROM verdict""")
def rename_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal gets a new name; each line names its shot and tree."""
    rows = t.event_rows(spark, sf)
    new = F.concat("signal", F.lit("n"))
    store = t.as_store(rows.unionByName(_copies(rows, F.col("user_id") + F.col("k"), "signal", new)))
    keys = rows.groupBy("shot", "tree", "signal").agg(F.min("event_id").alias("line_no"))
    mapping = keys.select("line_no", F.col("signal").alias("old_name"), new.alias("new_name"), "shot", "tree")
    return rn.rename_batch(store, mapping, "signal").verdicts.select(
        "shot", "tree", "old_name", "new_name", "verdict", "n_differences")


@query("rename_chain", f"""WITH {t.EVENTS}, names AS (SELECT shot, tree, signal, lead(signal) OVER (PARTITION BY shot, tree ORDER BY signal) AS up
  FROM (SELECT DISTINCT shot, tree, signal FROM ev))
 SELECT shot, tree, coalesce(up, signal || 'n') AS signal, count(*) AS n_nodes, max(event_id) AS last_id
 FROM ev JOIN names USING (shot, tree, signal) GROUP BY ALL""")
def rename_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal takes the name of the next one in its tree, the last a new one: a chain of dependent lines per tree."""
    rows = t.event_rows(spark, sf)
    keys = rows.select("shot", "tree", "signal", "k").distinct()
    tree = Window.partitionBy("shot", "tree").orderBy("signal")
    place = dense_ordinal(keys.select("shot", "tree").distinct().withColumn("place", F.struct("shot", "tree")), "place")
    mapping = keys.withColumn("up", F.coalesce(F.lead("signal").over(tree), F.concat("signal", F.lit("n")))).join(
        place.select("shot", "tree", "ordinal"), ["shot", "tree"]).select(
        (F.col("ordinal") * 8 - F.col("k")).alias("line_no"), F.col("signal").alias("old_name"), F.col("up").alias("new_name"), "shot", "tree")
    return t.summary(rn.rename_batch(t.as_store(rows), mapping, "signal").store.nodes)
