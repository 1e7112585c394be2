"""Requests, catalogs, chunks and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalvault.functions import naming
from signalvault.plans import acquisition as plan
from signalvault.sources.catalog import (
    header_blocks, missing_config_outcomes, parse_catalog, parse_catalog_lines, server_of, union_catalogs,
)
from signalvault.session import scratch_path
from signalvault.sources.files import usable_sources
from signalvault.sources.ledger import append_ledger, read_ledger
from signalvault.sources.text import lines_of, mapping_lines, numbered_lines, read_lines, shot_list
from signalvault.workload import tables as t
from signalvault.workload.registry import query


@query("shots_range", f"WITH {t.REQUESTED} SELECT shot_no, shot FROM req")
def shots_range(spark: SparkSession, sf: str) -> DataFrame:
    return t.requested(spark, sf)


@query("shots_list", rf"""WITH {t.LIST_LINES} SELECT doc_id, n, trim(line) AS shot FROM lst
 WHERE trim(line) <> '' AND NOT regexp_matches(line, '^\s*#')""")
def shots_list(spark: SparkSession, sf: str) -> DataFrame:
    return shot_list(numbered_lines(t.list_texts(spark, sf), "doc_id"))


@query("shots_list_file", rf"""WITH {t.LIST_LINES} SELECT trim(line) AS shot, count(*) AS n_lines FROM lst
 WHERE trim(line) <> '' AND NOT regexp_matches(line, '^\s*#') GROUP BY ALL""")
def shots_list_file(spark: SparkSession, sf: str) -> DataFrame:
    """All lists written to one folder of text files and read back by splits."""
    path = scratch_path(spark, "lists")
    t.list_texts(spark, sf).select("text").write.text(path)
    return shot_list(read_lines(spark, path)).groupBy("shot").agg(F.count(F.lit(1)).alias("n_lines"))


@query("catalog_parse", f"WITH {t.CATALOG_LINES} SELECT doc_id, ordinal, tree, signal FROM parsed")
def catalog_parse(spark: SparkSession, sf: str) -> DataFrame:
    return parse_catalog(t.catalog_texts(spark, sf), "doc_id")


@query("catalog_long", f"""WITH {t.LONG_CATALOG_LINES} SELECT source, doc_id, CAST(n AS BIGINT) AS n,
 row_number() OVER (PARTITION BY source ORDER BY doc_id, n) AS ordinal, tree, trim(line) AS signal
 FROM marked WHERE is_item AND tree IS NOT NULL""")
def catalog_long(spark: SparkSession, sf: str) -> DataFrame:
    """One catalog per source, too long for a row: its documents are its blocks, and a tree goes on in the next ones."""
    lines = numbered_lines(t.catalog_texts(spark, sf, "source"), "source", "doc_id")
    parsed = parse_catalog_lines(lines, "source", block="doc_id", place="n")
    return parsed.withColumn("n", F.col("n") - 1)  # less the line that opens the text of each document


@query("catalog_server", "SELECT doc_id, source || '.host:80' AS server FROM documents")
def catalog_server(spark: SparkSession, sf: str) -> DataFrame:
    return t.catalog_texts(spark, sf).select("doc_id", server_of(F.col("text")).alias("server"))


@query("catalog_union", f"""WITH {t.TYPE_CATALOG}, {t.PENDING}
 SELECT config, CAST(n_signals AS BIGINT) AS n_signals, CAST(failed_chunks AS BIGINT) AS failed_chunks FROM (
  SELECT config, count(*) AS n_signals, 0 AS failed_chunks FROM cat GROUP BY config
  UNION ALL SELECT 'absent.yaml', 0, (SELECT count(*) FROM pend))""")
def catalog_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two catalogs and one that is missing: the latter is a failed chunk of every shot."""
    catalog = t.type_catalog(spark, sf)
    parts = {name: catalog.where(F.col("config") == name).drop("config", "config_no") for name in ("main", "rest")}
    whole, missing = union_catalogs({**parts, "absent.yaml": None})
    shots = plan.pending(t.requested(spark, sf), t.completed(spark, sf))
    failed = missing_config_outcomes(shots, missing)
    return (
        whole.groupBy("config").agg(F.count(F.lit(1)).alias("n_signals"))
        .withColumn("failed_chunks", F.lit(0).cast("bigint"))
        .unionByName(failed.groupBy("config").agg(
            F.lit(0).cast("bigint").alias("n_signals"), F.count_if(F.col("exit_code") != 0).alias("failed_chunks")))
    )


_MAPPING = r"""map AS (SELECT c_custkey, c_name, c_mktsegment, c_custkey % 6 AS m FROM customer)"""


@query("mapping_read", f"""WITH {_MAPPING} SELECT c_custkey, CAST(1 AS BIGINT) AS line_no, c_name AS old_name, c_mktsegment AS new_name
 FROM map WHERE m IN (4, 5)""")
def mapping_read(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = mapping_lines(numbered_lines(t.mapping_texts(spark, sf), "c_custkey", any_end=True))
    return good


@query("mapping_rejects", f"""WITH {_MAPPING} SELECT c_custkey, CASE m WHEN 2 THEN 1 ELSE 3 END AS n_tokens
 FROM map WHERE m IN (2, 3)""")
def mapping_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = mapping_lines(numbered_lines(t.mapping_texts(spark, sf), "c_custkey", any_end=True))
    return bad.select("c_custkey", "n_tokens")


@query("ledger_read", f"WITH {t.ORDER_LEDGER} SELECT DISTINCT shot FROM led WHERE status = 'failed'")
def ledger_read(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger is written, entered again, and its failed shots are read back."""
    path = scratch_path(spark, "ledger")
    for _ in range(2):
        append_ledger(t.order_ledger(spark, sf), path)
    return read_ledger(spark, path, "failed").select("shot")


@query("sources_filter", """SELECT 3 AS src_ordinal, count(*) AS n_rows FROM lineitem
 UNION ALL SELECT 4, count(*) FROM customer""")
def sources_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Of four sources one is the target itself and one is missing."""
    paths = [f"{sf}/{n}.parquet" for n in ("orders", "no_such_table", "lineitem", "customer")]
    good, _ = usable_sources(spark, f"{sf}/orders.parquet", paths)
    counts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(i).alias("src_ordinal"), "n_rows") for i, p in good]
    return counts[0].unionByName(counts[1])


# -- names ------------------------------------------------------------------------

@query("path_build", f"""WITH {t.EVENTS} SELECT DISTINCT shot || '/' || tree AS tree_path,
 shot || '/' || tree || '/' || signal AS signal_path FROM ev""")
def path_build(spark: SparkSession, sf: str) -> DataFrame:
    keys = t.event_rows(spark, sf).select("shot", "tree", "signal").distinct()
    return keys.select(naming.path_of("shot", "tree").alias("tree_path"),
                       naming.path_of("shot", "tree", "signal").alias("signal_path"))


@query("file_names", f"""WITH {t.REQUESTED} SELECT shot, '/cscratch/data/' || shot || '.h5' AS output_file,
 shot || '.h5' AS file_name, shot AS stem, 'data/' || shot || '.h5' AS transfer_path FROM req""")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    out = t.requested(spark, sf).select("shot", naming.output_file("/cscratch/data", "shot").alias("output_file"))
    return out.select(
        "shot", "output_file", naming.base_name("output_file").alias("file_name"),
        naming.base_name("output_file", ".h5").alias("stem"),
        naming.without_prefix("output_file").alias("transfer_path"))


@query("chunk_label", f"""WITH {t.TYPE_CATALOG}, {t.PENDING},
 cnt AS (SELECT config_no, config, count(*) AS n FROM cat GROUP BY ALL)
 SELECT shot, config, chunk, 'config_' || config || '_' || shot || '_chunk' || chunk || '_77_' || (shot_no % 1000 + 1)
   || '.yml' AS label
 FROM (SELECT p.*, c.config, unnest(range(1, (c.n + 99) // 100 + 1)) AS chunk FROM pend p, cnt c)""")
def chunk_label(spark: SparkSession, sf: str) -> DataFrame:
    units = plan.chunk_plan(plan.pending(t.requested(spark, sf), t.completed(spark, sf)), t.type_catalog(spark, sf))
    file = F.concat(F.lit("conf/"), "config", F.lit(".yaml"))
    return units.select("shot", "config", "chunk", naming.chunk_label(
        file, "shot", "chunk", F.lit("77"), (F.col("shot_no") % 1000 + 1).cast("string")).alias("label"))


# -- pending shots, batches -------------------------------------------------------

@query("pending_shots", f"WITH {t.PENDING} SELECT shot_no, shot FROM pend")
def pending_shots(spark: SparkSession, sf: str) -> DataFrame:
    return plan.pending(t.requested(spark, sf), t.completed(spark, sf)).select("shot_no", "shot")


@query("pending_shots_list", f"""WITH {t.ORDER_LEDGER} SELECT CAST(l_orderkey AS VARCHAR) AS shot, count(*) AS times
 FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) NOT IN (SELECT shot FROM led WHERE status = 'completed')
 GROUP BY 1""")
def pending_shots_list(spark: SparkSession, sf: str) -> DataFrame:
    """A request with repeats: they survive."""
    listed = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("shot"))
    return plan.pending(listed, t.completed(spark, sf)).groupBy("shot").agg(F.count(F.lit(1)).alias("times"))


@query("pending_count", f"WITH {t.PENDING} SELECT count(*) AS pending, count(*) = 0 AS nothing_to_do FROM pend")
def pending_count(spark: SparkSession, sf: str) -> DataFrame:
    shots = plan.pending(t.requested(spark, sf), t.completed(spark, sf))
    return shots.agg(F.count(F.lit(1)).alias("pending")).withColumn("nothing_to_do", F.col("pending") == 0)


_BATCHES = """bat AS (SELECT shot, o AS ordinal, (o - 1) // 1000 + 1 AS batch, (o - 1) % 1000 + 1 AS task
  FROM (SELECT shot, row_number() OVER (ORDER BY shot_no) AS o FROM pend))"""


@query("batch_ids", f"WITH {t.PENDING}, {_BATCHES} SELECT * FROM bat")
def batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    shots = plan.pending(t.requested(spark, sf), t.completed(spark, sf))
    return plan.batched(shots, "shot_no").select("shot", "ordinal", "batch", "task")


@query("nth_shot", f"WITH {t.PENDING}, {_BATCHES} SELECT shot, batch, task FROM bat WHERE batch = 1 AND task = 42")
def nth_shot(spark: SparkSession, sf: str) -> DataFrame:
    shots = plan.pending(t.requested(spark, sf), t.completed(spark, sf))
    return plan.nth_shot(plan.batched(shots, "shot_no"), 1, 42).select("shot", "batch", "task")


@query("line_slice", f"WITH {t.DOC_LINES} SELECT doc_id, CAST(n AS BIGINT) AS n, line FROM ln WHERE n BETWEEN 2 AND 4")
def line_slice(spark: SparkSession, sf: str) -> DataFrame:
    lines = numbered_lines(t.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return plan.line_slice(lines, 2, 4)


@query("carry_forward_tree", f"""WITH {t.CATALOG_LINES} SELECT doc_id, CAST(n AS BIGINT) AS n, tree FROM marked
 WHERE NOT is_head AND tree IS NOT NULL""")
def carry_forward_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The last header above each line, header being any line whose length divides by 7."""
    lines = t.table(spark, sf, "documents").select("doc_id", lines_of(F.col("text")).alias("lines"))
    blocks = header_blocks(lines, lambda x: F.length(x) % 7 == 0, "doc_id")
    return blocks.select("doc_id", "head", "header", F.posexplode("items").alias("pos", "line")).select(
        "doc_id", (F.col("head") + F.col("pos") + 2).cast("bigint").alias("n"),
        F.concat(F.lit("T"), F.length("header").cast("string")).alias("tree"))


# -- chunks -----------------------------------------------------------------------

@query("chunk_ids", f"""WITH {t.PART_CATALOG} SELECT config, ordinal, signal, chunk, (chunk - 1) * 100 + 1 AS first_ordinal,
 least(chunk * 100, (SELECT count(*) FROM part)) AS last_ordinal FROM chk""")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    catalog = t.part_catalog(spark, sf)
    total = t.table(spark, sf, "part").agg(F.count(F.lit(1)))
    return plan.chunked(catalog).select(
        "config", "ordinal", "signal", "chunk", ((F.col("chunk") - 1) * 100 + 1).alias("first_ordinal"),
        F.least(F.col("chunk") * 100, total.scalar()).alias("last_ordinal"))


@query("catalog_counts", f"""WITH {t.TYPE_CATALOG} SELECT config, count(*) AS n_signals,
 (count(*) + 99) // 100 AS n_chunks FROM cat GROUP BY config""")
def catalog_counts(spark: SparkSession, sf: str) -> DataFrame:
    return plan.catalog_counts(t.type_catalog(spark, sf))


@query("chunk_counts", f"WITH {t.PART_CATALOG} SELECT config, chunk, count(*) AS n_signals FROM chk GROUP BY ALL")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return plan.chunk_counts(plan.chunked(t.part_catalog(spark, sf)))


_RUNS = """st AS (SELECT *, CASE WHEN lag(tree) OVER (PARTITION BY chunk ORDER BY ordinal) = tree THEN 0 ELSE 1 END AS s
   FROM chk),
 runs AS (SELECT config, chunk, ordinal, tree, signal,
   CAST(sum(s) OVER (PARTITION BY chunk ORDER BY ordinal) AS BIGINT) AS run FROM st)"""


@query("tree_runs", f"""WITH {t.PART_CATALOG}, {_RUNS} SELECT config, chunk, run, tree, min(ordinal) AS first_ordinal,
 max(ordinal) AS last_ordinal FROM runs GROUP BY ALL""")
def tree_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = plan.tree_runs(plan.chunked(t.part_catalog(spark, sf)))
    return runs.groupBy("config", "chunk", "run", "tree").agg(
        F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))


@query("group_chunk_by_tree", f"""WITH {t.PART_CATALOG}, {_RUNS} SELECT config, chunk, run, tree,
 string_agg(signal, ',' ORDER BY ordinal) AS signals FROM runs GROUP BY ALL""")
def group_chunk_by_tree(spark: SparkSession, sf: str) -> DataFrame:
    runs = plan.tree_runs(plan.chunked(t.part_catalog(spark, sf)))
    return plan.signals_by_run(runs).withColumn("signals", F.array_join("signals", ","))


# -- the plan ---------------------------------------------------------------------

@query("fetch_plan", f"""WITH {t.TYPE_CATALOG}, {t.PENDING},
 cnt AS (SELECT config_no, config, count(*) AS n FROM cat GROUP BY ALL),
 u AS (SELECT p.shot_no, p.shot, c.config, c.n, unnest(range(1, (c.n + 99) // 100 + 1)) AS chunk FROM pend p, cnt c)
 SELECT shot_no, shot, config, chunk, (chunk - 1) * 100 + 1 AS first_ordinal, least(chunk * 100, n) AS last_ordinal,
   least(chunk * 100, n) - (chunk - 1) * 100 AS n_signals FROM u""")
def fetch_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Pending shots with their fetch units."""
    shots = plan.pending(t.requested(spark, sf), t.completed(spark, sf)).select("shot_no", "shot")
    return plan.chunk_plan(shots, t.type_catalog(spark, sf)).drop("config_no")


@query("fetch_plan_signals", f"""WITH {t.TYPE_CATALOG}, {t.PENDING}
 SELECT config, (ordinal - 1) // 100 + 1 AS chunk, tree, signal, count(*) AS n_shots, min(shot_no) AS first_shot,
   max(shot_no) AS last_shot FROM pend, cat GROUP BY ALL""")
def fetch_plan_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Every pending shot with every catalog signal, rolled up per signal."""
    shots = plan.pending(t.requested(spark, sf), t.completed(spark, sf)).select("shot_no", "shot")
    return plan.signal_totals(shots, t.type_catalog(spark, sf))
