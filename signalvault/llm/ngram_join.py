"""N-gram Jaccard join by T-occurrence search.

Two texts link when the Jaccard similarity of their shingle sets reaches a bound. A set of n shingles needs
T = ceil(bound * n) common ones with any partner, so the search orders the inverted lists of a set from the
shortest to the longest and divides them (DivideSkip): the n - T + 1 short lists are merged, which finds every
partner at least once, and the T - 1 long ones are only probed by binary search in the partner's sorted set.

1. ``list_lengths``: shingle hashes go, packed in blocks, to groups of hash ranges that count how many sets hold
   each; the blocks get a length code for every shingle that more than one set holds. A set with fewer than T of
   those has no partner and goes no further, which removes most of a corpus before any list is built.
2. Equal sets become one representative.
3. The short lists are merged by an aggregate over (list, document). First each document meets only the first one
   of its lists (a pass linear in the lists) and its overlap is probed; the links found join most groups of copies.
4. Sets whose lists still hold several components go, once, to the tasks of their family, which run the whole
   T-occurrence search there (``t_occurrence``). Nothing is capped: every pair not known to be connected is met, and
   no pair that fails becomes a row.
5. Components of the links.

A shingle so common that even its group of all sets would be large is found in a bounded sample
(``sample_rows``) and ordered behind all others without being counted. Any choice of such shingles gives the same
result, since a prefix is right under every order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalvault.llm.common import (Words, block_group, block_number, flat, mix, power_of_two, ragged, shingles, slices,
                                    text_bytes, text_column)
from signalvault.llm.components import components
from signalvault.session import cut_lineage

GROUP_BYTES = 8 << 20
"""Text bytes whose shingles meet in one group of the counting step."""
BLOCK_SHINGLES = 1 << 19
BLOCK_ROWS = 1 << 16
"""Texts of a block at most, so that two bytes tell them apart."""
TASK_ROWS = 1 << 40
"""More rows than a task reads: row r of task t is number TASK_ROWS * t + r."""
HOT_SHARE = 1 / 64
"""Share of the sampled sets above which a shingle goes last uncounted."""
SAMPLE_ROWS = 4096
HOT = 255

_SENT = "pid long, block long, meta boolean, ids binary, a binary, b binary, c binary"
_REPLY = "block long, meta boolean, ids binary, a binary, b binary, c binary"
_SETS = "task long, place long, doc_id long, n long, d1 long, d2 long, hits long, keys binary, codes binary"


def _text_sets(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    words = Words(*flat(text_column(batch.column("text"))))
    value, bounds = shingles(words, width, lower=True)
    return batch.column("doc_id"), value, bounds


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def hot_shingles(documents: DataFrame, width: int, rows: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Sorted shingles that more than HOT_SHARE of a sample of about ``sample_rows`` texts hold.

    At most 1 / HOT_SHARE times the mean set size: the bound of what the tasks are given.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_text_sets(part, width)[1].view(np.int64))], ["h"])

    part = documents.sample(min(1.0, sample_rows / max(1, rows)), seed=7)
    least = max(32, int(min(rows, sample_rows) * HOT_SHARE))
    found = part.mapInArrow(count, "h long").groupBy("h").count().where(F.col("count") >= least).select("h").collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


def _send(width: int, parts: int, hot: np.ndarray) -> Callable:
    bits = parts.bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, ids, sizes, total, start, rows = 0, [], [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            number = block_number(count)
            value, doc = np.concatenate(held), np.repeat(np.arange(sum(map(len, ids))).astype(np.uint16), np.concatenate(sizes))
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            digests = (_sum(mix(value, 2), bounds), _sum(mix(value, 3), bounds))
            common = np.zeros(len(value), bool)
            if len(hot) and len(value):
                common = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value
            there = np.concatenate([x.is_valid().to_numpy(zero_copy_only=False) for x in ids])
            named = np.concatenate([x.fill_null(0).to_numpy() for x in ids])
            out = [(block_group(number, parts), number, True, named.tobytes() + there.tobytes() + np.int64(start).tobytes(), np.diff(bounds).astype(np.uint32).tobytes(),
                    digests[0].tobytes() + digests[1].tobytes(), doc[common].tobytes() + value[common].tobytes())]
            value, doc = value[~common], doc[~common]
            order = np.argsort(value)
            value, doc = value[order], doc[order]
            cut = np.searchsorted(value, np.arange(parts, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(value)]
            low = (value << np.uint64(bits)) >> np.uint64(16)
            for p in range(parts):
                a, b = cut[p], cut[p + 1]
                if a < b:
                    out.append((p, number, False, doc[a:b].tobytes(), (low[a:b] >> np.uint64(16)).astype(np.uint32).tobytes(),
                                (low[a:b] & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), None))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*out), [pa.int64(), pa.int64(), pa.bool_()] + [pa.binary()] * 4)], ["pid", "block", "meta", "ids", "a", "b", "c"])

        for part in slices(batches):
            doc, value, bounds = _text_sets(part, width)
            if ids and (total >= BLOCK_SHINGLES or rows + len(doc) > BLOCK_ROWS):
                yield block()
                count, held, ids, sizes, total, start, rows = count + 1, [], [], [], 0, start + rows, 0
            held.append(value), ids.append(doc), sizes.append(np.diff(bounds))
            total, rows = total + len(value), rows + len(doc)
        if ids:
            yield block()

    return send


def list_lengths(documents: DataFrame, width: int, bound: Fraction) -> DataFrame:
    """Per row of ``documents``: the task that reads it and its place there (together its key), n, set digest, and for
    sets that may have a partner the shared shingles in list order."""
    rows, size = text_bytes(documents)
    parts = max(8, power_of_two(size / GROUP_BYTES))
    bits = parts.bit_length() - 1
    hot = hot_shingles(documents, width, rows)

    def measure(group: pa.Table) -> pa.Table:
        """Length codes of the lists of one hash range, for the blocks that sent them."""
        pid = group.column("pid")[0].as_py()
        rows = group.to_pylist()
        sent = [r for r in rows if not r["meta"]]
        out = [(r["block"], True, r["ids"], r["a"], r["b"], r["c"]) for r in rows if r["meta"]]
        if sent:
            key = np.concatenate([np.frombuffer(r["a"], np.uint32) for r in sent]).astype(np.uint64) << np.uint64(16)
            key |= np.concatenate([np.frombuffer(r["b"], np.uint16) for r in sent])
            order = np.argsort(key)
            ordered = key[order]
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            length = np.diff(np.append(new, len(key)))
            code = np.where(length > 1, np.minimum(HOT - 1, 4 * np.log2(length)).astype(np.uint8), 0).astype(np.uint8)
            codes = np.empty(len(key), np.uint8)
            codes[order] = np.repeat(code, length)
            start = 0
            for r in sent:
                n = len(r["a"]) // 4
                mine = codes[start:start + n]
                shared = np.flatnonzero(mine)
                if len(shared):
                    low = key[start:start + n][shared]
                    full = (np.uint64(pid) << np.uint64(64 - bits)) | (low << np.uint64(16 - bits) if bits <= 16 else low >> np.uint64(bits - 16))
                    out.append((r["block"], False, np.frombuffer(r["ids"], np.uint16)[shared].tobytes(), full.tobytes(),
                                mine[shared].tobytes(), None))
                start += n
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*out), [pa.int64(), pa.bool_()] + [pa.binary()] * 4)] if out else [pa.array([], t) for t in [pa.int64(), pa.bool_()] + [pa.binary()] * 4],
            ["block", "meta", "ids", "a", "b", "c"])

    def assemble(group: pa.Table) -> pa.Table:
        """Rows of one block of documents from the replies of all groups."""
        rows = group.to_pylist()
        meta = next(r for r in rows if r["meta"])
        n = np.frombuffer(meta["a"], np.uint32).astype(np.int64)
        ids, named = np.frombuffer(meta["ids"], np.int64, len(n)), np.frombuffer(meta["ids"], bool, len(n), 8 * len(n))
        start = int(np.frombuffer(meta["ids"][9 * len(n):], np.int64)[0])
        digest = np.frombuffer(meta["b"], np.int64).reshape(2, -1)
        there = len(meta["c"]) // 10
        doc = [np.frombuffer(meta["c"], np.uint16, there)]
        mask = np.uint64((2**64 - 1) ^ (2 ** (16 - bits) - 1)) if bits < 16 else np.uint64(2**64 - 1)
        key, code = [np.frombuffer(meta["c"][2 * there:], np.uint64) & mask if there else np.zeros(0, np.uint64)], [np.full(there, HOT, np.uint8)]
        for r in rows:
            if not r["meta"]:
                doc.append(np.frombuffer(r["ids"], np.uint16)), key.append(np.frombuffer(r["a"], np.uint64)), code.append(np.frombuffer(r["b"], np.uint8))
        doc, key, code = np.concatenate(doc), np.concatenate(key), np.concatenate(code)
        hits = np.bincount(doc, minlength=len(ids))
        need = -(-n * bound.numerator // bound.denominator)
        alive = (n > 0) & (hits >= need)
        keep = alive[doc]
        doc, key, code = doc[keep], key[keep], code[keep]
        order = np.lexsort((key, code, doc))
        doc, key, code = doc[order], key[order], code[order]
        cut = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
        return pa.Table.from_arrays([
            pa.array(np.full(len(ids), meta["block"] >> 32, np.int64)), pa.array(start + np.arange(len(ids))), pa.array(ids, mask=~named), pa.array(n), pa.array(digest[0]), pa.array(digest[1]), pa.array(hits),
            pa.array([key[a:b].tobytes() if ok else None for a, b, ok in zip(cut, cut[1:], alive)], pa.binary()),
            pa.array([code[a:b].tobytes() if ok else None for a, b, ok in zip(cut, cut[1:], alive)], pa.binary())],
            ["task", "place", "doc_id", "n", "d1", "d2", "hits", "keys", "codes"])

    given = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    replies = given.mapInArrow(_send(width, parts, hot), _SENT).groupBy("pid").applyInArrow(measure, _REPLY)
    return replies.groupBy("block").applyInArrow(assemble, _SETS)


def _postings(sets: DataFrame, bound: Fraction) -> DataFrame:
    """(key, rep, n): the short lists. Shingles that one set alone holds come first in the order and need no list."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, reps, sizes = [], [], []
            for rep, n, key in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("keys")):
                data = np.frombuffer(key.as_buffer(), np.int64)
                need = -(-n * bound.numerator // bound.denominator)
                short = n - need + 1 - (n - len(data))
                keys.append(data[:max(0, short)])
                reps.append(np.full(len(keys[-1]), rep)), sizes.append(np.full(len(keys[-1]), n))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, reps, sizes)], ["key", "rep", "n"])

    return sets.select("rep", "n", "keys").mapInArrow(post, "key long, rep long, n long")


def _probe(pairs: DataFrame, sets: DataFrame, bound: Fraction) -> DataFrame:
    """Of the candidate ``pairs`` (a, b) those whose sets overlap enough."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, bottom = bound.numerator, bound.denominator
        for batch in batches:
            kept = []
            for i, (na, nb, x, y) in enumerate(zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(),
                                                   batch.column("ka"), batch.column("kb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                short, long = (x, np.sort(y)) if len(x) <= len(y) else (y, np.sort(x))
                at = np.searchsorted(long, short)
                same = int(np.count_nonzero(long[np.minimum(at, len(long) - 1)] == short)) if len(long) else 0
                if same * bottom >= top * (na + nb - same):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(kept, pa.int64())), batch.column("b").take(pa.array(kept, pa.int64()))], ["a", "b"])

    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(probe, "a long, b long")


def t_occurrence(rep: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray, keys: list[np.ndarray],
                 bound: Fraction) -> list[tuple[int, int]]:
    """Links that join different components among the given sets; ``side`` 0 and 1 meet each other, 2 meets all.

    Each set searches the inverted lists of the others: its shortest lists are merged, the candidates they yield
    are probed in its long lists by binary search, a few lists at a time, and leave as soon as the overlap their
    sizes require is out of reach. Pairs already connected are skipped.
    """
    top, bottom = bound.numerator, bound.denominator
    count = len(rep)
    owner = np.repeat(np.arange(count), [len(k) for k in keys])
    number = np.unique(np.concatenate(keys), return_inverse=True)[1] if len(owner) else owner
    place = np.sort(number * count + owner)  # every inverted list, one after another
    bounds = np.searchsorted(place, np.arange(int(number.max()) + 2 if len(owner) else 1) * count)
    docs = place % count
    length = np.diff(bounds)
    own = np.split(number, np.cumsum([len(k) for k in keys])[:-1])
    root = np.searchsorted(np.unique(component), component)

    links = []
    for q in range(count):
        lists = own[q][np.argsort(length[own[q]], kind="stable")]
        need = -(-int(n[q]) * top // bottom)
        short = max(0, len(lists) - need + 1)
        if not short:
            continue
        hits = np.bincount(docs[ragged(bounds[lists[:short]], length[lists[:short]])], minlength=count)
        fits = (hits > 0) & (root != root[q]) & (n * bottom >= n[q] * top) & (n[q] * bottom >= n * top)
        fits[:q + 1] = False
        if side[q] != 2:
            fits &= side != side[q]
        found = np.flatnonzero(fits)
        overlap = hits[found]
        required = -(-(n[found] + n[q]) * top // (top + bottom))
        for start in range(short, len(lists), 16):
            left = len(lists) - start
            reach = overlap + left >= required
            found, overlap, required = found[reach], overlap[reach], required[reach]
            if not len(found):
                break
            probe = (lists[start:start + 16, None] * count + found[None, :]).ravel()
            at = np.minimum(np.searchsorted(place, probe), len(place) - 1)
            overlap = overlap + (place[at] == probe).reshape(-1, len(found)).sum(axis=0)
        for c in found[overlap >= required].tolist():
            if root[c] != root[q]:
                links.append((int(rep[q]), int(rep[c])))
                root[root == root[c]] = root[q]
    return links


FAMILY = 1024
"""Sets of a block: two blocks at most meet in one task."""


def _search_families(rest: DataFrame, sets: DataFrame, bound: Fraction) -> DataFrame:
    """Links between different components of sets that meet in the lists of ``rest`` (rep, first set of the list,
    component). Sets that lists connect are a family; a family of more than FAMILY sets is dealt into blocks, every
    two of which meet in a task, small families share one."""
    near = components(rest.select(F.col("rep").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "family")
    members = cut_lineage(rest.groupBy("rep").agg(F.min("component").alias("component"))
                          .join(near, F.col("rep") == F.col("node")).select("rep", "component", "family"))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    total = members.count()
    tasks = max(1, total // FAMILY)
    blocks = F.ceil(F.col("members") / FAMILY).cast("int")
    member = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")
    dealt = members.join(sizes, "family").withColumn("blocks", blocks).withColumn("mine", member) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("rep", "component",
                F.when(F.col("blocks") > 1, F.col("family")).otherwise(-1 - F.pmod(F.xxhash64("family"), F.lit(tasks))).alias("family"),
                F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("rep", "ascending")])
        keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("keys")]
        rep, n, component, side = (group.column(c).to_numpy() for c in ("rep", "n", "component", "side"))
        found = t_occurrence(rep, n, component, side, keys, bound)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return cut_lineage(dealt.join(sets, "rep").groupBy("family", "i", "j").applyInArrow(search, "a long, b long"))


def row_classes(documents: DataFrame, width: int = 4, bound: tuple[int, int] = (85, 100)) -> tuple[DataFrame, DataFrame]:
    """Rows of ``documents`` with the number of their class, and the classes of sets.

    The first has task and place (of the row, in the order in which Spark reads ``documents``), doc_id, n, linked (may
    it share its class with others?) and class; the second has class and ``least``, the smallest doc_id of a set.
    """
    limit = Fraction(*bound)
    top, bottom = limit.numerator, limit.denominator
    table = cut_lineage(list_lengths(documents, width, limit))
    number = (F.col("task") * TASK_ROWS + F.col("place"))
    alive = table.where("keys is not null")
    reps = cut_lineage(alive.groupBy("d1", "d2", "n").agg(F.min(F.struct("task", "place")).alias("row"), F.min("doc_id").alias("least"))
                       .select("d1", "d2", "n", "row.task", "row.place", "least").withColumn("rep", number))
    sets = cut_lineage(alive.select("task", "place", "keys").join(reps, ["task", "place"]).select("rep", "n", "keys"))
    lists = cut_lineage(_postings(sets, limit))
    # a list holds partners of like size only; the first of each list and size band leads it
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(bottom / top))) if top < bottom else F.col("n")
    banded = lists.withColumn("band", band)
    leaders = banded.groupBy("key", "band").agg(F.min(F.struct("n", "rep")).alias("lead"), F.count(F.lit(1)).alias("length")).where("length > 1")
    pairs = banded.join(leaders, ["key", "band"]).where("rep <> lead.rep").select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut_lineage(_probe(cut_lineage(pairs), sets, limit))
    first = components(links)
    labelled = cut_lineage(lists.join(first, lists.rep == first.node, "left")
                           .select("key", "rep", "n", F.coalesce("component", "rep").alias("component")))
    open_lists = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rep").alias("first")) \
        .where("low < high").select("key", "first")
    rest = cut_lineage(labelled.join(open_lists, "key").select("rep", "first", "component").distinct())
    more = _search_families(rest, sets, limit)
    final = components(links.union(more)) if more.limit(1).count() else first
    classes = cut_lineage(reps.join(final, reps.rep == final.node, "left")
                          .select("d1", "d2", "n", "least", F.coalesce("component", "rep").alias("class")))
    # rows without a possible partner need no join
    row = ["task", "place", "doc_id", "n"]
    joined = alive.select(*row, "d1", "d2").join(classes.drop("least"), ["d1", "d2", "n"]).select(*row, F.lit(True).alias("linked"), "class")
    alone = table.where("keys is null").select(*row, F.lit(False).alias("linked"), number.alias("class"))
    return joined.union(alone), classes.groupBy("class").agg(F.min("least").alias("least"))


def ngram_classes(documents: DataFrame, width: int = 4, bound: tuple[int, int] = (85, 100)) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable by links, the document's own included. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. A text with fewer than ``width`` words has one shingle of all its words;
    null, empty or wordless text has none and links with nothing. Repeated rows are copies of each other; a row without
    doc_id links like any other, its component is null where no row of it has one. A long text is one set, however
    long. An empty table gives no rows. ``documents`` is read more than once and must give the same rows in the same
    order, as files do.
    """
    rows, classes = row_classes(documents, width, bound)
    return rows.join(classes, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


BITMAP_ROWS = 32768


def first_of_classes(documents: DataFrame, width: int = 5, bound: tuple[int, int] = (80, 100)) -> DataFrame:
    """``documents`` without the rows that are copies: of each class the row of the least doc_id stays, rows without one
    behind all others, the first one read of equal ones.

    Decisions are taken per row, so different texts that share a doc_id do not take each other along. They go back to
    the rows as bitmaps, one for 32,768 rows of a task that has something to drop, and no text is shuffled unless even
    these are too large to broadcast. Columns stay as they are.
    """
    rows, _ = row_classes(documents, width, bound)
    joined = cut_lineage(rows.where("linked").select("class", "task", "place", "doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "task", "place")
    first = joined.groupBy("class").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "f.task", "f.place")
    gone = joined.join(first.select("class", F.col("task").alias("t"), F.col("place").alias("p")), "class").where("task <> t or place <> p")
    chunk, bit = F.floor(F.col("place") / BITMAP_ROWS), F.col("place") % BITMAP_ROWS
    bitmaps = cut_lineage(gone.groupBy("task", chunk.alias("chunk")).agg(F.bitmap_construct_agg(bit).alias("bits")))
    at = F.monotonically_increasing_id()  # the task's number above 33 bits of the row's place in it
    place = at.bitwiseAND((1 << 33) - 1)
    spare = [c for c in ("_task", "_place", "_task_", "_place_") if c not in [x.lower() for x in documents.columns]][:2]
    numbered = documents.withColumn(spare[0], F.shiftright(at, 33).cast("long")).withColumn(spare[1], place)
    marked = numbered.join(bitmaps.select(F.col("task").alias("b_task"), F.col("chunk").alias("b_chunk"), F.col("bits").alias("b_bits")),
                           (F.col(spare[0]) == F.col("b_task")) & (F.floor(F.col(spare[1]) / BITMAP_ROWS) == F.col("b_chunk")), "left")
    inside = F.col(spare[1]) % BITMAP_ROWS
    byte = F.conv(F.hex(F.substring("b_bits", F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    dropped = F.coalesce(F.getbit(byte, (inside % 8).cast("int")) == 1, F.lit(False))
    return marked.where(~dropped).select(*documents.columns)
