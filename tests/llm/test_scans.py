"""Secret scans, toxicity and media chunks against plain versions."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from signalvault.llm import media_chunks, toxicity
from signalvault.llm.automaton import Automaton
from signalvault.llm.common import Words, flat
from signalvault.llm.media_chunks import cuts, gear, media_columns, payload_of
from signalvault.llm.secret_scan import RULES, Rule, Scanner, masked, scan_secrets
from signalvault.llm.toxicity import ToxicityModel, fit, maximal_segments, score_toxicity

PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "AKIA", "A", "Z9", "deadbeef", "0123", "abcdef", "xyz",
         "_", "-", "é", "😀", "\n", ",", "ghp_", "xoxb-", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "q+/"]
PLAIN = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2),
         (re.compile("(AKIA[A-Z0-9]+)"), 1), (re.compile("([0-9a-f]+)"), 1), (re.compile("(gh[oprsu]_[A-Za-z0-9]+)"), 1),
         (re.compile("(xox[abprs]-[A-Za-z0-9-]+)"), 1), (re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)"), 1),
         (re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY----(-+)"), 1)]


def plain_spans(text):
    found = [(m.start(), m.end(), i) for i, (p, g) in enumerate(PLAIN) for m in p.finditer(text) if len(m[g]) >= RULES[i].least]
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_spans():
    r = random.Random(2)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(80))) for _ in range(1500)]
    texts += ["", "ab12" * 5000, "token=" + "x" * 20_000, "secret " * 3000, "x" * 9000 + " token = " + "y" * 12]
    got = Scanner().spans(*flat(pa.array(texts)))
    assert [got.get(i, []) for i in range(len(texts))] == [plain_spans(t) for t in texts]


def test_resolving_is_linear():
    """Texts where a search from every byte would read on to the end each time."""
    jwt = "eyJa.eyJb." + "x" * 16 + "." + "eyJ" * 300_000
    spaces = "token=abcdefghijkl " + "password" * 40_000 + " " * 300_000
    keys = "-----BEGIN PRIVATE KEY-----" + "-----BEGIN " + "A " * 300_000
    scanner = Scanner.of(RULES)
    began = time.process_time()
    found = scanner.spans(*flat(pa.array([jwt, spaces, keys])))
    assert time.process_time() - began < 6
    assert found == {0: [(0, 26, 5)], 1: [(0, 18, 0)], 2: [(0, 27 + 5, 6)]}


def test_resolving_is_linear_where_runs_pass_their_match():
    """After ``k=a`` each run looks for a semicolon up to the end of the stretch."""
    rule = Rule("x", "k=(?:[^,]*;)?", "", "[a-z]", 1)
    scanner = Scanner((rule,))
    text = "k=a-" * 100_000
    began = time.process_time()
    got = scanner.resolve(text.encode(), 0)
    assert time.process_time() - began < 6
    assert got == [(i, i + 3) for i in range(0, len(text), 4)]
    assert scanner.resolve(b"k=a-k=b;c-k=d", 0) == [(0, 9), (10, 13)]


def test_reversed_automaton_marks_starts():
    marks = Automaton(["a(?:bc|d)*e+"], search=True, back=True)
    text, s, at = b"abcdee-ae-abe", 0, []
    for i in range(len(text) - 1, -1, -1):
        s = int(marks.table[s, marks.classes[text[i]]])
        if marks.accepts[s]:
            at.append(i)
    assert at == [7, 0]


def test_automaton_is_minimal():
    assert len(Automaton(["a{3}", "b"], search=False).table) == 6  # four counts, one b end, the dead state
    assert len(Automaton(["(?:ab|ac)d", "(?:ab|ac)d"], search=False).table) == 5


def test_secret_columns(spark, documents, awkward):
    rows = [*awkward, (20, "é token = abcdefabcdefabcdef01 AKIA" + "B" * 20, "a")]
    found = {r.n: r.secrets for r in scan_secrets(documents(rows)).collect()}
    assert len(found) == len(rows) and [tuple(s) for s in found[len(rows) - 1]] == [("assign", 2, 30), ("hex", 10, 30), ("access", 31, 55)]
    assert all(not found[i] for i in range(len(awkward)))
    texts = {r.n: r.text for r in scan_secrets(documents(rows), mask=True).collect()}
    assert texts[len(rows) - 1] == "é [assign] [access]" and texts[0] is None and texts[5] == awkward[5][1]
    assert masked("abcdef", [(1, 3, "x"), (2, 4, "y"), (4, 5, "z")]) == "a[x][z]f"
    assert scan_secrets(documents([])).count() == 0


def segments(score, base=0):
    """By definition: the best segment, then the same left and right of it."""
    total = np.concatenate([[0], np.cumsum(score)])
    best, at = 0.0, None
    for i in range(len(score)):
        for j in range(i + 1, len(score) + 1):
            if total[j] - total[i] > best + 1e-12:
                best, at = total[j] - total[i], (i, j)
    if at is None:
        return []
    i, j = at
    return segments(score[:i], base) + [(base + i, base + j)] + segments(score[j:], base + j)


def test_maximal_segments():
    r = np.random.default_rng(4)
    for _ in range(200):
        score = r.normal(-0.3, 1, r.integers(0, 25))
        got = maximal_segments(score)
        assert [(a, b) for a, b, _ in got] == segments(score)
        assert all(abs(s - score[a:b].sum()) < 1e-9 for a, b, s in got)


def labelled(spark, documents, bad="vile", n=400):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split()) for _ in range(r.randrange(20, 80))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), bad + r.choice(["", "st", "ness"]))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_stems(spark, documents, awkward):
    docs, labels = labelled(spark, documents)
    model = fit(docs, labels, train=lambda d: d % 4 != 3)
    scored = score_toxicity(docs, model).join(labels, "doc_id").where("doc_id % 4 = 3")
    wrong = scored.where("(toxicity.score >= 0.5) <> (toxic = 1)").count()
    assert wrong <= 1
    passage = scored.where("toxic = 1 and toxicity.score >= 0.5").first()
    assert any("vile" in passage.text[s.start:s.end] for s in passage.toxicity.passages)
    odd = score_toxicity(documents([*awkward, (30, "a vileish thing, vile! VILE", "a")]), model).collect()
    assert len(odd) == len(awkward) + 1 and all(0 <= r.toxicity.score <= 1 for r in odd)
    assert {r.doc_id for r in odd if r.toxicity.score >= 0.5} == {30}
    assert score_toxicity(documents([]), model).count() == 0


def test_no_form_is_cut(spark, documents, monkeypatch):
    docs, labels = labelled(spark, documents)
    whole = fit(docs, labels)
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 5, raising=False)
    assert len(whole.features) > 5 and np.array_equal(fit(docs, labels).features, whole.features)


def test_one_class_or_no_labels_score_low(spark, documents):
    docs, labels = labelled(spark, documents, n=40)
    for few in (labels.where("toxic = 0"), labels.limit(0), labels.selectExpr("cast(null as long) doc_id", "toxic")):
        assert score_toxicity(docs, fit(docs, few)).where("toxicity.score >= 0.5").count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy(spark):
    from signalvault.llm.queries import op6_toxicity

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = op6_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").toPandas()
    toxic, hit = rows.toxic == 1, rows.predicted == 1
    assert (toxic == hit).mean() > 0.97 and (hit & toxic).sum() > 0.85 * toxic.sum() and (hit & ~toxic).sum() < 0.015 * (~toxic).sum()


def test_model_without_features_gives_the_drift():
    model = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.5, 1.0, 0.0, np.zeros(4))
    assert (model.token_scores(Words(*flat(pa.array(["a b", ""])), letters=True)) == -0.5).all()


def test_gear_depends_on_the_last_32_bytes():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 256, 400, dtype=np.uint8), r.integers(0, 256, 400, dtype=np.uint8)
    b[200:] = a[200:]
    assert (gear(a)[231:] == gear(b)[231:]).all() and (gear(a)[200:231] != gear(b)[200:231]).any()
    assert len(gear(a[:1])) == 1


def test_cuts_keep_their_bounds():
    r = random.Random(1)
    for _ in range(200):
        size = r.randrange(1, 60_000)
        ends = cuts(sorted(r.sample(range(1, size + 1), min(size, r.randrange(30)))), size)
        lengths = [b - a for a, b in zip([0, *ends], ends)]
        assert ends[-1] == size and all(0 < x <= media_chunks.MOST for x in lengths) and all(x >= media_chunks.LEAST for x in lengths[:-1])


def test_media(spark, documents, awkward, folder):
    r = random.Random(3)
    base = "".join(r.choice("abcdefghij ") for _ in range(40_000))
    rows = [*awkward, *[(100 + i, base[:5000 * i] + f"edit {i}" + base[5000 * i:], "a") for i in range(8)]]
    got = media_columns(documents(rows), folder + "/m").collect()
    want = {}
    for doc_id, text, _ in rows:
        data = (text or "").encode()
        payload = payload_of(data)
        want[doc_id] = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload) + 44)
    assert len(got) == len(rows)
    assert {x.doc_id: (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32, x.media_bytes) for x in got} == want
    stored = spark.read.parquet(folder + "/m").selectExpr("sum(length(held)) held").first().held
    distinct = {v[2]: v[1] for v in want.values()}
    assert stored < sum(distinct.values()) - 6 * 20_000  # the edited copies share most chunks
    assert media_columns(documents([]), folder + "/e").count() == 0


def test_damaged_chunks_are_found(spark, documents, folder):
    media_columns(documents(["some text " * 500]), folder + "/m").collect()
    row = spark.read.parquet(folder + "/m").first().asDict(recursive=True) | {"borrowed": []}
    assert media_chunks.restore(row)[44:] == payload_of(("some text " * 500).encode())
    with pytest.raises(ValueError, match="missing or damaged"):
        media_chunks.restore(row | {"held": row["held"][::-1]})
