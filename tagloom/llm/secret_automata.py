"""Secret scans: rule spans, and formats learned by grammar inference.

Three fixed rules find base spans. The values they find in a bounded sample of
documents are labelled credentials. For every kind a prefix tree of its values is
built and states are merged to a probabilistic automaton of the format:

* states that fewer than ``EVIDENCE`` values pass cannot be told apart by what
  follows them; those of one depth whose paths used the same classes of characters
  are one state, so position, length, alphabet and separators are kept;
* the other states are merged in red-blue order if a Hoeffding test finds no
  difference between them and between all that follows them (Alergia). States
  without that evidence are never taken for equal.

Every other candidate of the whole texts, a run of ``CANDIDATE_MIN`` or more value
characters or what base spans leave of one, is scored by its log likelihood under
the automata, its end included, against a character model of ordinary candidates;
one that reaches the level of the weakest twentieth of held-out credentials of its kind becomes a
span of kind ``format``.

Learning is bounded: about ``SAMPLE_DOCS`` documents, chosen by the hash of the
text, of these ``SAMPLE_VALUES`` values a kind and ``SAMPLE_ORDINARY`` ordinary
ones, chosen by their own hash, none of more than ``LONGEST_LEARNED`` characters.
Scanning covers every text whole.

Defined results: a null or empty text has no spans; repeated rows get equal
spans; positions count code points, ends are exclusive; ids play no part. Without
labelled credentials there are no automata and only base spans come out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import kept_columns, materialize, ref, schema_of, text_slices, with_arrays

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN, CANDIDATE_MIN = 12, 18, 16, 12

SAMPLE_DOCS, SAMPLE_VALUES, SAMPLE_ORDINARY, LONGEST_LEARNED = 20_000, 1000, 4000, 256
#: Merge test: states count as equal unless they differ at this level of significance; it takes so many values to tell.
MERGE_ALPHA, EVIDENCE = 0.05, 20
_DRAWS = 1 << 40

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])

_VALUE, _HEX = 1, 2
_CLASS = np.zeros(129, np.uint8)
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-":
    _CLASS[ord(_c)] |= _VALUE
for _c in "0123456789abcdef":
    _CLASS[ord(_c)] |= _HEX


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values with at least ``least`` of them."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _scan(joined: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind, end) and candidate runs of one string; a line feed ends every match."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _CLASS[np.minimum(codes, 128)]
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(joined) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(joined) if m.end() - m.start() >= ACCESS_MIN]
    spans += [(a, 2, b) for a, b in zip(*(x.tolist() for x in _runs(classes & _HEX > 0, HEX_MIN)))]
    spans.sort()
    # what base spans leave of the runs of value characters
    left = classes & _VALUE > 0
    for a, _, b in spans:
        left[a:b] = False
    starts, ends = _runs(left, CANDIDATE_MIN)
    return spans, list(zip(starts.tolist(), ends.tolist()))


# --- grammar inference ------------------------------------------------------

_CLASSES = ("0123456789", "abcdef", "ABCDEF", "ghijklmnopqrstuvwxyz", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-")
#: bit of a character's class; separators are classes of their own
CLASS_BIT = {c: 1 << i for i, cs in enumerate(_CLASSES) for c in cs}


class Automaton:
    """Probabilistic automaton: per state the transitions, their counts, the count of ends and of values that pass."""

    def __init__(self, values: list[str], evidence: int = EVIDENCE):
        self.evidence = evidence
        self.next: list[dict[str, int]] = [{}]
        self.counts: list[dict[str, int]] = [{}]
        self.ends, self.seen = [0], [0]
        passing = Counter(v[:i] for v in values for i in range(1, len(v) + 1))
        names: dict[object, int] = {}
        for value in values:
            at, used = 0, 0
            for i, c in enumerate(value):
                used |= CLASS_BIT.get(c, 0)
                # the prefix's own state, or that of its depth and classes where too few values pass
                name = value[: i + 1] if passing[value[: i + 1]] >= evidence else (i + 1, used)
                if name not in names:
                    names[name] = len(self.next)
                    self.next.append({})
                    self.counts.append({})
                    self.ends.append(0)
                    self.seen.append(0)
                self.seen[at] += 1
                self.counts[at][c] = self.counts[at].get(c, 0) + 1
                self.next[at][c] = names[name]
                at = names[name]
            self.seen[at] += 1
            self.ends[at] += 1
        # a character that no value had here leads where its class does
        for name, at in [("", 0), *names.items()]:
            depth, used = (len(name), sum({CLASS_BIT.get(c, 0) for c in name})) if isinstance(name, str) else name
            for c, bit in CLASS_BIT.items():
                to = names.get((depth + 1, used | bit))
                if to is not None and (used & bit or not depth):
                    self.next[at].setdefault(c, to)
                    self.counts[at].setdefault(c, 0)
        self.same = list(range(len(self.next)))
        self._merge_compatible()
        self.next = [{c: self._of(t) for c, t in row.items()} for row in self.next]
        self.alphabet = len({c for s in self.reachable() for c in self.counts[s]}) + 1

    def reachable(self) -> list[int]:
        found, todo = {0}, [0]
        while todo:
            for t in self.next[todo.pop()].values():
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return sorted(found)

    def _of(self, state: int) -> int:
        """The state that a merged one has become."""
        while self.same[state] != state:
            self.same[state] = self.same[self.same[state]]
            state = self.same[state]
        return state

    def _alike(self, a: int, b: int, apart: set[tuple[int, int]], path: set[tuple[int, int]]) -> bool:
        """Hoeffding test of two states and of all that follows them; ``apart`` keeps pairs that failed."""
        a, b = self._of(a), self._of(b)
        pair = (min(a, b), max(a, b))
        if a == b or pair in path:
            return True
        if pair in apart:
            return False
        na, nb = self.seen[a], self.seen[b]
        if min(na, nb) < self.evidence:
            return True  # nothing speaks against it; whether that is enough is asked of the first pair only
        bound = math.sqrt(0.5 * math.log(2 / MERGE_ALPHA)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        shares = [(self.ends[a] / na, self.ends[b] / nb)] + [(self.counts[a].get(c, 0) / na, self.counts[b].get(c, 0) / nb) for c in self.counts[a].keys() | self.counts[b].keys()]
        path.add(pair)
        good = all(abs(x - y) <= bound for x, y in shares) and all(self._alike(self.next[a][c], self.next[b][c], apart, path) for c in sorted(self.next[a].keys() & self.next[b].keys()))
        if not good:
            apart.add(pair)
        return good

    def _merge(self, into: int, other: int) -> None:
        """Make two states one, and with them their successors by equal characters."""
        todo = [(into, other)]
        while todo:
            a, b = map(self._of, todo.pop())
            if a == b:
                continue
            self.same[b] = a
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, n in self.counts[b].items():
                self.counts[a][c] = self.counts[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_compatible(self) -> None:
        red, apart = [0], set()
        while True:
            red = list(dict.fromkeys(map(self._of, red)))
            border = {self._of(t) for r in red for t in self.next[r].values()} - set(red)
            if not border:
                return
            blue = max(border, key=lambda t: (self.seen[t], -t))
            known = self.seen[blue] >= self.evidence
            twin = next((r for r in red if known and self.seen[r] >= self.evidence and self._alike(r, blue, apart, set())), None)
            if twin is None:
                red.append(blue)
            else:
                self._merge(twin, blue)
                apart = set()  # counts have changed

    def log_likelihood(self, value: str) -> float:
        """Of the value as a whole: its characters and its end."""
        state, total = 0, 0.0
        for c in value:
            if state is None:
                return total - (math.log(10 * self.alphabet)) * 2 * len(value)  # left the format: no such value
            total += math.log((self.counts[state].get(c, 0) + 0.5) / (self.seen[state] + 0.5 * self.alphabet))
            state = self.next[state].get(c)
        if state is None:
            return total - math.log(10 * self.alphabet) * len(value)
        return total + math.log((self.ends[state] + 0.5) / (self.seen[state] + 0.5 * self.alphabet))


class Background:
    """Character model of ordinary candidates: pairs, mixed with single characters, as many words hold a pair never seen."""

    def __init__(self, values: list[str]):
        self.pairs: dict[str, int] = defaultdict(int)
        self.firsts: dict[str, int] = defaultdict(int)
        self.single: dict[str, int] = defaultdict(int)
        for value in values:
            for a, b in zip("\n" + value, value):
                self.pairs[a + b] += 1
                self.firsts[a] += 1
                self.single[b] += 1
        self.total = sum(self.single.values())

    def _share(self, a: str, b: str) -> float:
        alone = (self.single.get(b, 0) + 0.5) / (self.total + 0.5 * len(CLASS_BIT))
        return 0.8 * self.pairs.get(a + b, 0) / max(1, self.firsts.get(a, 0)) + 0.2 * alone

    def log_likelihood(self, value: str) -> float:
        return sum(math.log(self._share(a, b)) for a, b in zip("\n" + value, value))


class SecretModel:
    """Automata by kind, the background, and for each kind the score from which a candidate counts as a secret."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        fit = {k: v[: max(1, len(v) * 4 // 5)] for k, v in credentials.items() if v}
        self.automata = {k: Automaton(v) for k, v in sorted(fit.items())}
        self.background = Background(ordinary)
        self.least = {}
        for k in self.automata:
            held = sorted(self.ratios(v)[k] for v in credentials[k][len(fit[k]) :])
            self.least[k] = max(0.5, held[len(held) // 20]) if held else 0.5

    def ratios(self, value: str) -> dict[str, float]:
        """Log likelihood ratio a character by kind."""
        ordinary = self.background.log_likelihood(value)
        return {k: (a.log_likelihood(value) - ordinary) / len(value) for k, a in self.automata.items()}

    def score(self, value: str) -> float | None:
        """Ratio of the best format among those whose level the value reaches; None if it reaches none."""
        return max((r for k, r in self.ratios(value).items() if r >= self.least[k]), default=None) if value else None


def learn(df: DataFrame, *, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_values: int = SAMPLE_VALUES, sample_ordinary: int = SAMPLE_ORDINARY) -> SecretModel:
    """Fit the automata on the base values of a bounded sample of documents (a count and one scan; only the chosen values reach the driver)."""
    fraction = min(1.0, sample_docs / max(1, df.count()))
    sample = df.where(F.pmod(F.xxhash64(ref(text_col)), F.lit(_DRAWS)) < int(fraction * _DRAWS) + 1).select(ref(text_col).alias("_tl_text"))
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])

    def values(batches):
        for _, texts in text_slices(batches, "_tl_text"):
            joined = "\n".join(t or "" for t in texts)
            spans, free = _scan(joined)
            rows = {(KINDS[k], ASSIGN.match(joined, a, b)[2] if k == 0 else joined[a:b]) for a, k, b in spans}
            rows |= {("ordinary", joined[a:b]) for a, b in free}
            rows = sorted(r for r in rows if len(r[1]) <= LONGEST_LEARNED)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["kind", "value"])

    found = materialize(sample.mapInArrow(values, schema).distinct(), "secrets-sample")
    picked: dict[str, list[str]] = {}
    rows = None
    for kind, most in [*((k, sample_values) for k in KINDS[:3]), ("ordinary", sample_ordinary)]:
        part = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(most)
        rows = part if rows is None else rows.unionByName(part)
    for r in rows.collect():
        picked.setdefault(r["kind"], []).append(r["value"])
    for kind in picked:  # an order of their own, whatever the plan
        picked[kind].sort(key=lambda v: (hash_of(v), v))
    return SecretModel({k: picked.get(k, []) for k in KINDS[:3]}, picked.get("ordinary", []))


def hash_of(value: str) -> int:
    import zlib

    return zlib.crc32(value.encode("utf-8", "surrogatepass"))


def _spans_of(texts: list[str | None], model: SecretModel) -> list[list[tuple[int, int, int, float]]]:
    """Per text its spans (start, kind, end, score) in order of start, then kind."""
    texts = [t or "" for t in texts]
    joined = "\n".join(texts)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    spans, free = _scan(joined)
    scored = [(a, k, b, 1.0) for a, k, b in spans]
    if model.automata:
        known: dict[str, float | None] = {}  # ordinary words come again and again
        for a, b in free:
            value = joined[a:b]
            if value not in known:
                known[value] = model.score(value)
            if known[value] is not None:
                scored.append((a, 3, b, round(known[value], 6)))
    scored.sort()
    out: list[list] = [[] for _ in texts]
    owners = np.searchsorted(begins, [s[0] for s in scored], "right") - 1
    for (a, k, b, s), d in zip(scored, owners.tolist()):
        at = int(begins[d])
        out[d].append((a - at, k, b - at, s))
    return out


def find_spans(df: DataFrame, model: SecretModel, *, text_col: str = "text", keep=("doc_id",), out_col: str = "secret_spans") -> DataFrame:
    """``keep`` columns and an array of spans (kind, start, end, score)."""
    keep = kept_columns(df, keep, [out_col])
    schema = schema_of(df, keep, [(out_col, T.ArrayType(SPAN))])
    columns = [ref(c) for c in keep] + [ref(text_col).alias("_tl_text")]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch, texts in text_slices(batches, "_tl_text"):
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in spans] for spans in _spans_of(texts, model)]
            yield with_arrays(batch, keep, schema, [pa.array(rows, kind)])

    return df.select(*columns).mapInArrow(run, schema)


def redact(df: DataFrame, model: SecretModel, *, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """All columns and rows; in ``text_col`` every stretch covered by spans is replaced by ``mask`` (and ``length_col`` follows)."""
    schema, names = df.schema, df.columns

    def run(batches):
        for batch, texts in text_slices(batches, text_col):
            clean = []
            for text, spans in zip(texts, _spans_of(texts, model)):
                parts, at = [], 0
                for a, _, b, _ in spans:
                    if a >= at:
                        parts += [text[at:a], mask]
                    at = max(at, b)
                clean.append("".join([*parts, text[at:]]) if spans else text)
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(clean, pa.string())
            if length_col in names:
                old = columns[names.index(length_col)]
                changed = [len(c) if c is not None and c != t else o for c, t, o in zip(clean, texts, old.to_pylist())]
                columns[names.index(length_col)] = pa.array(changed, old.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(spans: DataFrame, *, id_col: str = "doc_id", span_col: str = "secret_spans") -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans as text."""

    def of(kind: str) -> Column:
        return F.size(F.filter(F.col(span_col), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(F.col(span_col), lambda s: s["kind"] != "format")
    counts = [of(k) for k in KINDS]
    return spans.select(id_col, *counts, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col(span_col)).alias("spans"))
