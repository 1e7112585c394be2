"""The registered queries of the text operators, each beside its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalvault.llm.common import ship
from signalvault.llm.media_chunks import media_columns
from signalvault.llm.mixing import mix
from signalvault.llm.nearest import nearest
from signalvault.llm.ngram_join import ngram_classes
from signalvault.llm.quotation_links import conversations
from signalvault.llm.secret_scan import BASE, scan_secrets
from signalvault.llm.sentencepiece_bpe import round_trip
from signalvault.llm.simhash import simhash_classes
from signalvault.llm.substring_dedup import remove_repeats
from signalvault.llm.token_files import read_tokens, write_tokens
from signalvault.llm.toxicity import fit, score_toxicity
from signalvault.llm.turn_repair import repair
from signalvault.llm.vector_codes import compress
from signalvault.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"), 4, (85, 100))


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path)


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def kind(name: str):
        return F.filter("secrets", lambda s: s.kind == name)

    base = F.filter("secrets", lambda s: s.kind.isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[F.size(kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), 35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"), train=lambda doc_id: ~held_out(doc_id))
    scored = score_toxicity(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxicity.score").alias("score"),
                         (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.size("toxicity.passages").alias("n_passages"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS most,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, encode(source) NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, encode(source) NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size,
         coalesce(least(most, weight * (SELECT level FROM levels WHERE most >= level * weight
                                        ORDER BY most / weight, encode(source) NULLS LAST LIMIT 1)), most) AS target
  FROM levels),
steps AS (
  SELECT s.doc_id, s.source, s.size, s.hash, t.source_size, t.target, floor(t.target / nullif(t.source_size, 0)) AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(s.size) OVER (PARTITION BY s.source, s.hash) AS tied
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
chosen AS (
  SELECT *, coalesce(whole < 3 AND before + tied <= target - whole * source_size, false) AS inside FROM steps),
rests AS (
  SELECT *, target - whole * source_size - sum(CASE WHEN inside THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest FROM chosen),
fills AS (
  SELECT source AS fill_source, arg_min(hash, {'gap': abs(rest - size), 'hash': hash}) AS extra
  FROM rests WHERE NOT inside AND whole < 3 AND abs(rest - size) < rest GROUP BY source)
SELECT doc_id, size, source_size, target,
       CAST(size * (coalesce(whole, 0) + CASE WHEN inside OR coalesce(whole < 3 AND hash = extra, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rests LEFT JOIN fills ON source IS NOT DISTINCT FROM fill_source
"""


@query("op3_mixing", OP3_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_nearest")
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


@query("op4_media_chunks")
def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), scratch_path(spark, "media"))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, conv_id * 100000 + turn AS message_id, turn, role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
         min(turn) OVER (PARTITION BY conv_id) AS first_turn,
         CAST(lag(conv_id * 100000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR) AS reply_to
  FROM conversations)
SELECT conv_id * 100000 + first_turn AS conversation_id, position, CAST(position - 1 AS INTEGER) AS depth, message_id, reply_to, role,
       regexp_replace(text, '^\s+|\s+$', '', 'g') AS text
FROM turns
"""


def quoting_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of ``conversations`` as messages that quote the two turns before them, their conversation forgotten."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def earlier(back: int) -> DataFrame:
        return turns.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("text").alias(f"text{back}"))

    def quote(name: str, signs: str):
        return F.concat(F.lit(signs), F.regexp_replace(F.col(name), "\n", f"\n{signs}"))

    return turns.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("message_id"), "role",
        F.concat_ws("\n", quote("text2", "> > "), quote("text1", "> "), F.col("text")).alias("text"))


@query("op9_quotation_links", OP9_SQL)
def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(quoting_messages(spark, sf_dir)).withColumn("reply_to", F.col("reply_to").cast("string"))


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"), width=4, distance=4)


def op12_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds as chained expressions: codebook ``b<r>``, nearest entries ``n<r>``."""
    out = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pieces AS MATERIALIZED (
  SELECT row, p, list_slice(x, CAST(p * len(x) // {parts} + 1 AS BIGINT), CAST((p + 1) * len(x) // {parts} AS BIGINT)) AS x
  FROM kept, range({parts}) AS parts(p)),
b0 AS MATERIALIZED (
  SELECT p, e, pieces.x AS c
  FROM (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM kept) JOIN pieces USING (row) WHERE e < {entries})"""]
    for r in range(rounds + 1):
        out.append(f"""n{r} AS MATERIALIZED (
  SELECT row, p, pieces.x, min({{'d': list_sum(list_transform(list_zip(pieces.x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS near
  FROM pieces JOIN b{r} USING (p) GROUP BY row, p, pieces.x)""")
        if r < rounds:
            out.append(f"""t{r} AS (
  SELECT p, near.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v
  FROM n{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, near.e, i),
b{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b{r}.c) AS c FROM b{r} LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS c FROM t{r} GROUP BY p, e) m USING (p, e))""")
    out.append(f"""coded AS (
  SELECT row, string_agg(lpad(to_hex(near.e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM n{rounds} GROUP BY row),
all_labels AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN kept USING (row) GROUP BY label)
SELECT vec_id, lower(code) AS code, error, label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (row) JOIN all_labels ON kept.label IS NOT DISTINCT FROM all_labels.label""")
    return ",\n".join(out[:-1]) + ",\n" + out[-1]


@query("op12_vector_codes", op12_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(table(spark, sf_dir, "embeddings"))
    by_label = found.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op13_sql() -> str:
    """The cheapest and then least way to the end of each state, from the last turn back: cost, audit and lines."""
    def add(cost: str, letter: str, line: str | None, state: int, of: str) -> str:
        body = f"list_prepend({line}, {of}{state}.body)" if line else f"{of}{state}.body"
        return f"{{'cost': {cost} + {of}{state}.cost, 'audit': '{letter}' || {of}{state}.audit, 'body': {body}}}"

    after = {0: 2, 1: 2, 2: 3, 3: 2}
    said = {2: "'user'", 3: "'assistant'"}
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    read = []
    for s in range(4):
        ways = [f"[{add('3', 'D', None, s, 'g')}]",
                f"CASE WHEN fixed THEN [] ELSE [{add('2 + late', 'R', said[after[s]] + chr(39).join([' || ', ':', ' || text']), after[s], 'g')}] END"]
        for initial, to in kept.items():
            if s in to:
                ways.append(f"CASE WHEN fixed OR initial <> '{initial}' THEN [] ELSE [{add('late', 'K', 'role || chr(58) || text', to[s], 'g')}] END")
        read.append(f"list_min({' || '.join(ways)}) AS h{s}")
    first = [f"list_min([h{s}, {add('2', 'I', said[after[s]] + ' || chr(58)', after[s], 'h')}]) AS g{s}" for s in (2, 3)]
    then = [f"list_min([h{s}, {add('2', 'I', said[after[s]] + ' || chr(58)', after[s], 'g')}]) AS g{s}" for s in (0, 1)]
    done = "{'cost': 0::BIGINT, 'audit': '', 'body': []::VARCHAR[]}"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS bytes(i)),
harmed AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations), crc),
turns AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM harmed, LATERAL (SELECT unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy) WHERE harm <> 0),
placed AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS time,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns),
judged AS MATERIALIZED (
  SELECT *, bare = '' AS blank, bare <> '' AND time > 1 AS again,
         bare <> '' AND time = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         bare = '' OR time > 1 AS fixed, CAST(bare <> '' AND time = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS BIGINT) AS late,
         place > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS wrong
  FROM placed),
ways AS (
  SELECT DISTINCT conv_id, n + 1 AS place, {done} AS g0, {{'cost': 4::BIGINT, 'audit': 'II', 'body': ['user:', 'assistant:']}} AS g1,
         {{'cost': 2::BIGINT, 'audit': 'I', 'body': ['assistant:']}} AS g2, {done} AS g3
  FROM judged
  UNION ALL
  SELECT conv_id, place, {', '.join(then)}, g2, g3
  FROM (SELECT *, {', '.join(first)} FROM (
    SELECT w.conv_id, j.place, {', '.join(read)}
    FROM ways w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.place = w.place - 1))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (wrong) AS illegal
  FROM judged GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(g0.cost, 0) AS cost, coalesce(g0.audit, '') AS audit,
       sha256(coalesce(array_to_string(g0.body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON c.conv_id IS NOT DISTINCT FROM counts.conv_id
LEFT JOIN ways ON c.conv_id IS NOT DISTINCT FROM ways.conv_id AND ways.place = 1
"""


@query("op13_turn_repair", op13_sql())
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
