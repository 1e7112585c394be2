"""Secret scans with one deterministic automaton for all rules.

Every rule is compiled, by subset construction and minimisation, into one searching automaton over bytes; one pass
over the bytes finds where a rule may match. The pass runs in lanes: bytes that lead every state back to the start
(line ends, commas and the like) cut a slice of texts into stretches that are scanned side by side, one array step
a byte. Stretches that some rule fires in, which are few, are resolved to exact spans, leftmost, longest and not
overlapping per rule: the rule's automaton for reversed text marks the bytes where matches start, and the anchored one
runs forward from the first mark behind the last match. Both passes are linear in the stretch, whatever it holds.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalvault.llm.automaton import Automaton
from signalvault.llm.common import flat, slices, text_column, with_column

LANE = 512
LONGEST_LANE = 8192
"""Steps that lanes are scanned side by side; what is left of a longer stretch is scanned by itself."""


@dataclass(frozen=True)
class Rule:
    """A match is lead, fixed, then one or more tail bytes, as many as there are. It counts when fixed and tail have
    ``least`` bytes or more; a shorter match uses its bytes up all the same. ``sure`` tail bytes make the scan fire."""

    kind: str
    lead: str
    fixed: str
    tail: str
    least: int
    sure: int = 1

    def pattern(self) -> str:
        return f"{self.lead}{self.fixed}{self.tail}+"

    def fires(self) -> str:
        return f"{self.lead}{self.fixed}{self.tail}{{{self.sure}}}"


# The base rules every scan has, in the order of their listing.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "", "[A-Za-z0-9+/_.=-]", 12),
    Rule("access", "", "AKIA", "[A-Z0-9]", 18, 2),
    Rule("hex", "", "", "[0-9a-f]", 16, 16),
)
# Added by this operator: formats of tokens with a public prefix.
ADDED = (
    Rule("github", "", "gh[oprsu]_", "[A-Za-z0-9]", 40, 2),
    Rule("slack", "", "xox[abprs]-", "[A-Za-z0-9-]", 20, 2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "", "[A-Za-z0-9_-]", 16, 1),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY----", "", "-", 1, 1),
)
RULES = BASE + ADDED


class Scanner:
    """The compiled rules."""

    @classmethod
    @functools.cache
    def of(cls, rules: tuple[Rule, ...]) -> Scanner:
        """One a worker process: later tasks find it compiled."""
        return cls(rules)

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.search = Automaton([r.fires() for r in rules], search=True)
        self.scalar = self.search.lists()
        self.exact = []
        for r in rules:
            whole, lead = Automaton([r.pattern()], search=False), Automaton([r.lead], search=False) if r.lead else None
            marks = Automaton([r.pattern()], search=True, back=True)
            self.exact.append((marks.lists(), whole.lists(), whole.dead, lead and lead.lists(), lead and lead.dead))

    def fired(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, start, end, rule bits) of the stretches of a slice in which rules fire."""
        table, accepts = self.search.flat, self.search.accepts
        width = self.search.table.shape[1]
        codes = self.search.classes[data].astype(np.int64)
        resets = np.flatnonzero(self.search.resets[data])
        cuts = np.arange(LANE, len(data), LANE)
        at = np.searchsorted(resets, cuts)
        cuts = np.unique(np.concatenate([resets[at[at < len(resets)]] + 1, offsets]))
        starts, lengths = cuts[:-1], np.diff(cuts)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(min(longest, LONGEST_LANE)), "left").tolist()
        state = np.zeros(len(starts), np.int64)
        bits = np.zeros(len(starts), np.int64)
        rare = accepts != 0
        for step, n in enumerate(active):
            now = table[state[:n] * width + codes[starts[:n] + step]]
            state[:n] = now
            hit = rare[now]
            if hit.any():
                where = np.flatnonzero(hit)
                bits[where] |= accepts[now[where]]
        rows, outs, _ = self.scalar
        for lane in np.flatnonzero(lengths > LONGEST_LANE).tolist():
            s, found = int(state[lane]), int(bits[lane])
            for byte in data[starts[lane] + LONGEST_LANE:starts[lane] + lengths[lane]].tobytes():
                s = rows[s][byte]
                found |= outs[s]
            bits[lane] = found
        lanes = np.flatnonzero(bits)
        row = np.searchsorted(offsets, starts[lanes], "right") - 1
        return sorted(zip(row.tolist(), starts[lanes].tolist(), (starts + lengths)[lanes].tolist(), bits[lanes].tolist()))

    def resolve(self, data: bytes, rule: int) -> list[tuple[int, int]]:
        """Matches of one rule in a stretch that no match crosses.

        A run starts only where a match does, so it reads its match and what follows it until no longer match is
        possible. States met there are noted with their place, and a later run that meets one ends: no state is
        passed twice at one place.
        """
        (back, marks, _), (rows, accepts, _), dead, lead, lead_dead = self.exact[rule]
        least, n, s = self.rules[rule].least, len(data), 0
        begins = bytearray(n)
        for i in range(n - 1, -1, -1):
            s = back[s][data[i]]
            if marks[s]:
                begins[i] = 1
        out, barren = [], set()
        start = begins.find(1)
        while start >= 0:
            s, i, end, beyond = 0, start, start, []
            while i < n:
                s = rows[s][data[i]]
                i += 1
                if s == dead:
                    break
                if accepts[s]:
                    end = i
                    if beyond:
                        beyond = []
                elif end > start:
                    if (s, i) in barren:
                        break
                    beyond.append((s, i))
            barren.update(beyond)
            body = start
            if lead:
                s, i = 0, start
                while i < end and s != lead_dead:
                    s = lead[0][s][data[i]]
                    i += 1
                    if lead[1][s]:
                        body = i
            if end - body >= least:
                out.append((start, end))
            start = begins.find(1, end)
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Row -> (start, end, rule) in code points, ordered by start, then rule."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for row, start, end, bits in self.fired(data, offsets):
            piece = data[start:end].tobytes()
            base = start - int(offsets[row])
            for rule in range(len(self.rules)):
                if bits >> rule & 1:
                    found.setdefault(row, []).extend((base + a, base + b, rule) for a, b in self.resolve(piece, rule))
        out = {}
        for row, spans in found.items():
            if spans:
                text = data[offsets[row]:offsets[row + 1]]
                points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                out[row] = sorted((int(points[a]), int(points[b]), r) for a, b, r in spans)
                out[row].sort(key=lambda x: (x[0], x[2]))
        return out


def scan_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mask: bool = False,
                 name: str = "secrets") -> DataFrame:
    """All columns of ``documents`` and ``name`` (in place of one of that name): (kind, start, end) in code points, by
    start, then rule order.

    A null text holds no secrets and stays null; an empty one holds none. Texts of any length are scanned whole, in time
    linear in them. Repeated rows are scanned each by itself, an empty table gives an empty one. With ``mask`` the spans
    are replaced in the text by ``[kind]`` (of the first of overlapping spans) and no column is added.
    """
    if mask:
        schema = documents.schema
    else:
        documents, schema = with_column(documents, name, "array<struct<kind:string,start:int,end:int>>")
    entry = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(rules)
        for part in slices(batches, text):
            spans = scanner.spans(*flat(text_column(part.column(text))))
            if not mask:
                value = [[{"kind": rules[r].kind, "start": a, "end": b} for a, b, r in spans.get(i, ())] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.list_(entry))], [*part.schema.names, name])
                continue
            place = part.schema.names.index(text)
            texts = part.column(place)
            if spans:
                own = texts.to_pylist()
                for i, found in spans.items():
                    own[i] = masked(own[i], [(a, b, rules[r].kind) for a, b, r in found])
                texts = pa.array(own, texts.type)
            yield pa.RecordBatch.from_arrays([*part.columns[:place], texts, *part.columns[place + 1:]], part.schema.names)

    return documents.mapInArrow(scan, schema)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first."""
    out, at, until = [], 0, 0
    for start, end, kind in spans:
        if start >= until:
            out += [text[at:start], f"[{kind}]"]
        until = max(until, end)
        at = until
    return "".join(out) + text[at:]
