"""Personal data: fixed patterns find seeds, and bootstrapped contexts find identifiers that no pattern knows."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY_BUCKETS, bucket_flags, materialise, release
from .text import U64, chunks, mix, span_hashes, words_of

#: The kinds of the fixed patterns, and the one that only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs are taken whole: a match that begins or ends inside a run of digits never succeeds where the whole run fails.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Seeds of secrets: keys of 128, 160 and 256 bits in hexadecimal. A seed is reported only where a pattern vouches for it.
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])")
_EDGE = b"\"'()[]{}<>|,.;:!?*#$%&="
_IS_EDGE = np.zeros(256, bool)
_IS_EDGE[list(_EDGE)] = True
_IS_GROUP = np.zeros(256, bool)
_IS_GROUP[list(b"0123456789().+-")] = True


@dataclass(frozen=True)
class PiiConfig:
    """A pattern needs ``support`` different seeds of a kind, and that share ``confidence`` of all its occurrences has
    one; an instance needs ``accept``. In each of ``rounds`` rounds the instances accepted before count as seeds; a
    round without new ones is the last."""

    support: int = 3
    confidence: float = 0.6
    accept: float = 0.8
    rounds: int = 2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # from each '@' outwards: a search from the left would try every start of a long run
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start; offsets in code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = m.group().split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


class Words:
    """The words of some texts with their spans without punctuation, numbers of several groups as one span, and contexts."""

    def __init__(self, texts: list[str]) -> None:
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join(encoded) + b"\n"
        b = np.frombuffer(self.raw, np.uint8)
        self.begin = np.append(0, np.cumsum([len(t) + 1 for t in encoded]))[: len(texts)]
        self.first = np.flatnonzero((b & 0xC0) != 0x80)  # the first byte of each character
        self.char = np.searchsorted(self.first, self.begin)  # the number of each text's first character
        self.start, self.end = words_of(self.raw)
        self.h = span_hashes(self.raw, self.start, self.end)
        n = len(self.h)
        self.text = np.searchsorted(self.begin, self.start, "right") - 1
        group, digit = np.append(0, np.cumsum(_IS_GROUP[b])), np.append(0, np.cumsum((b >= 48) & (b <= 57)))
        numeric = (group[self.end] - group[self.start] == self.end - self.start) & (digit[self.end] > digit[self.start])
        joined = np.zeros(n, bool)  # a group that goes on with the next word
        joined[:-1] = numeric[:-1] & numeric[1:] & (self.start[1:] == self.end[:-1] + 1) & (self.text[1:] == self.text[:-1])
        self.head = np.append(True, ~joined[:-1])[:n]  # words that begin a span
        stops = np.flatnonzero(~joined)
        self.last = stops[np.searchsorted(stops, np.arange(n))] if n else stops  # the word in which the span ends
        self.solid = np.append(np.flatnonzero(~_IS_EDGE[b]), len(b))
        self.s, self.e = self.stripped(self.start, self.end[self.last])
        self.label = np.zeros(n, bool)
        self.label[1:] = np.isin(b[self.end[:-1] - 1], (58, 61))

    def stripped(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans without punctuation at their edges; an empty one where there is nothing else."""
        s = np.minimum(self.solid[np.searchsorted(self.solid, start)], end)
        return s, np.maximum(self.solid[np.searchsorted(self.solid, end) - 1] + 1, s)

    def contexts(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patterns (hashes, and whether they are there) of spans from word i to word j: the two words to the left; the
        words on both sides; the word to the left if it ends in a colon or an equals sign."""
        n = len(self.h)

        def beside(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.clip(k, 0, max(n - 1, 0))
            return self.h[at], (k >= 0) & (k < n) & (self.text[at] == self.text[i])

        (left, l1), (before, l2), (right, r1) = beside(i - 1), beside(i - 2), beside(j + 1)
        pats = np.stack([mix(before * U64(3) + left), mix(left * U64(5) + right), mix(left ^ U64(0x5A5A))], 1)
        return pats, np.stack([l2, l1 & r1, l1 & self.label[i]], 1)

    def inner(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels within words, as in name=value: word, first byte of the value, and pattern."""
        b = np.frombuffer(self.raw, np.uint8)
        sign = np.flatnonzero((b == 61) | (b == 58))
        word = np.searchsorted(self.start, sign, "right") - 1
        keep = np.append(True, word[1:] != word[:-1])[: len(word)] & (sign < self.end[word] - 1)  # the first one of a word
        sign, word = sign[keep], word[keep]
        return word, sign + 1, mix(span_hashes(self.raw, self.start[word], sign + 1) ^ U64(0x5A5A))


@dataclass
class Found:
    """Occurrences: text, kind (-1: none yet), span in bytes, instance, and patterns with whether they are there."""

    text: np.ndarray
    kind: np.ndarray
    s: np.ndarray
    e: np.ndarray
    inst: np.ndarray
    pats: np.ndarray
    there: np.ndarray


def seeds(text: str) -> list[tuple[int, int, int]]:
    """Base spans and seeds of secrets that touch none of them."""
    base = base_spans(text)
    if not _DIGIT.search(text):
        return base
    touches = _touching([(s, e) for _, s, e in base])
    more = [(BASE_KINDS, m.start(), m.end()) for m in _SECRET.finditer(text) if _DIGIT.search(m.group()) and re.search("[a-f]", m.group())]
    return base + [x for x in more if not touches(x[1], x[2])]


def _touching(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span touches one of these."""
    spans = sorted(spans)
    starts, far = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    return lambda start, end: (k := bisect_left(starts, end)) > 0 and far[k - 1] > start


def _only_edges(raw: bytes, start: int, end: int) -> bool:
    """Whether punctuation alone, of 64 bytes at most, is between a context and a seed."""
    return bool(end - start <= 64 and not raw[start:end].strip(_EDGE))


def occurrences(texts: list[str], flags: np.ndarray | None) -> tuple[Words, Found]:
    """Every seed and, with ``flags`` (of pattern or instance buckets), every other span (kind -1) that has a flagged
    pattern or is a flagged instance and touches no seed."""
    own = [(t, *x) for t, text in enumerate(texts) for x in seeds(text)]
    w = Words(texts)
    t, kind, start, stop = (np.array(c, np.int64) for c in (zip(*own) if own else ([],) * 4))
    s, e = w.first[w.char[t] + start], w.first[w.char[t] + stop]
    i, j = np.searchsorted(w.start, s, "right") - 1, np.searchsorted(w.start, e - 1, "right") - 1
    word, value, label = w.inner()
    pats, there = w.contexts(i, j)
    at = np.minimum(np.searchsorted(word, i), max(len(word) - 1, 0))
    for k in range(len(s)):
        there[k] &= _only_edges(w.raw, w.start[i[k]], s[k])
        if len(word) and word[at[k]] == i[k] and value[at[k]] <= s[k] and _only_edges(w.raw, value[at[k]], s[k]):
            pats[k, 2], there[k] = label[at[k]], (False, False, True)
    found = [Found(t, kind, s, e, span_hashes(w.raw, s, e), pats, there)]
    if flags is not None and len(w.h):
        order = np.argsort(s, kind="stable")
        starts, far = s[order], np.maximum.accumulate(e[order]) if len(e) else e

        def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            k = np.searchsorted(starts, b) - 1
            return (k < 0) | (far[np.maximum(k, 0)] <= a) if len(far) else np.ones(len(a), bool)

        def flagged(x: np.ndarray) -> np.ndarray:
            return flags[(x & U64(KEY_BUCKETS - 1)).astype(np.int64)]

        i = np.flatnonzero(w.head & (w.s < w.e))
        pats, there = w.contexts(i, w.last[i])
        inst = span_hashes(w.raw, w.s[i], w.e[i])
        hit = ((flagged(pats) & there).any(1) | flagged(inst)) & apart(w.s[i], w.e[i])
        i = i[hit]
        found.append(Found(w.text[i], np.full(len(i), -1), w.s[i], w.e[i], inst[hit], pats[hit], there[hit]))
        a, b = w.stripped(value, w.end[word])
        hit = flagged(label) & (a < b) & apart(a, b)
        pats = np.repeat(label[hit][:, None], 3, 1)
        found.append(Found(w.text[word[hit]], np.full(len(pats), -1), a[hit], b[hit], span_hashes(w.raw, a[hit], b[hit]), pats, np.tile([False, False, True], (len(pats), 1))))
    return w, Found(*(np.concatenate([getattr(f, c) for f in found]) for c in Found.__annotations__))


def _rows(docs: DataFrame) -> DataFrame:
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.xxhash64(doc, "text").alias("rid"), "text")


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    for k in range(b.num_rows):
        yield k, b.column(2)[k].as_py() or ""


def _groups(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for top in range(0, b.num_rows, 256):
        texts = [t or "" for t in b.column(2).slice(top, 256).to_pylist()]
        for group in chunks(texts, lambda t: len(t) + 1, 1 << 18):
            yield b.slice(top, len(group)), group
            top += len(group)


def _edges(docs: DataFrame, flags: np.ndarray | None) -> DataFrame:
    """occurrences() of all texts: doc_id, rid, start, stop, inst, kind, pats."""
    shared = None if flags is None else docs.sparkSession.sparkContext.broadcast(flags)
    names = ["doc_id", "rid", "start", "stop", "inst", "kind", "pats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _groups(b):
                w, f = occurrences(texts, shared and shared.value)
                of = pa.array(f.text)
                start, stop = (pa.array(np.searchsorted(w.first, x) - w.char[f.text]) for x in (f.s, f.e))
                ends = np.append(0, np.cumsum(f.there.sum(1))).astype(np.int32)
                pats = pa.ListArray.from_arrays(pa.array(ends), pa.array(f.pats[f.there].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), start, stop, pa.array(f.inst.view(np.int64)), pa.array(f.kind), pats], names=names)
        release()

    return _rows(docs).mapInArrow(run, "doc_id long, rid long, start long, stop long, inst long, kind long, pats array<long>")


def _totals(docs: DataFrame, flags: np.ndarray) -> DataFrame:
    """pat, n: how often each flagged pattern occurs in all texts, with any instance; a task sums before it sends."""
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pats, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pats, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(pats)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for _, texts in _groups(b):
                _, f = occurrences(texts, shared.value)
                pats = f.pats[f.there]
                held.append(np.unique(pats[shared.value[(pats & U64(KEY_BUCKETS - 1)).astype(np.int64)]], return_counts=True))
                if sum(len(p) for p, _ in held) > 1 << 20:
                    held = [summed(held)]
                    if len(held[0][0]) > 1 << 19:
                        pats, n = held.pop()
                        yield pa.RecordBatch.from_arrays([pa.array(pats.view(np.int64)), pa.array(n)], names=["pat", "n"])
        if held:
            pats, n = summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(pats.view(np.int64)), pa.array(n)], names=["pat", "n"])
        release()

    return _rows(docs).mapInArrow(run, "pat long, n long").groupBy("pat").agg(F.sum("n").alias("n"))


def bootstrap(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """doc_id, rid, kind, start, stop of what patterns add to the base spans.

    Seeds have confidence 1 for their kind. In each round the contexts of the known instances are patterns. Of those
    with enough different ones, a pattern's confidence for a kind is the confidence of its known occurrences, summed and
    divided by the number of all its occurrences; an instance's is one minus the product of the doubts of the different
    patterns beside it. Instances accepted in a round are known in the next. What is looked up in the texts is a table
    of KEY_BUCKETS flags: where it fills up, more is read and nothing is lost. Counts are combined before a shuffle. An
    occurrence is added where a pattern that vouches for its kind is beside it.
    """
    seen = materialise(_edges(docs, None)).select("inst", "kind", F.explode("pats").alias("pat"))
    votes = seen.groupBy("pat", "kind", "inst").agg(F.count(F.lit(1)).cast("double").alias("s"))
    base = materialise(votes)
    known, places = base, None
    for k in range(cfg.rounds):
        strong = known.groupBy("pat", "kind").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("insts")).filter(F.col("insts") >= cfg.support)
        strong = materialise(strong)
        total = _totals(docs, bucket_flags(strong.select("pat")))
        strong = strong.join(total, "pat").withColumn("p", F.col("s") / F.col("n")).filter(F.col("p") >= cfg.confidence)
        strong = materialise(strong.select("pat", "kind", "p"))
        open_spans = _edges(docs, bucket_flags(strong.select("pat"))).filter(f"kind < 0 or kind = {BASE_KINDS}")
        places = open_spans.select("doc_id", "rid", "start", "stop", "inst", F.explode("pats").alias("pat"))
        places = materialise(places.join(strong, "pat"))
        doubt = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6))))
        scored = places.select("inst", "kind", "pat", "p").distinct().groupBy("inst", "kind").agg((1 - F.exp(doubt)).alias("conf"))
        best = scored.groupBy("inst").agg(F.max(F.struct("conf", -F.col("kind"))).alias("b"))
        accepted = best.select("inst", (-F.col("b.col2")).alias("kind"), F.col("b.conf").alias("conf")).filter(F.col("conf") >= cfg.accept)
        accepted = materialise(accepted)
        new = accepted.join(known.select("inst"), "inst", "left_anti")
        if k + 1 == cfg.rounds or new.isEmpty():
            break
        fresh = accepted.join(base.select("inst"), "inst", "left_anti")
        beside = _edges(docs, bucket_flags(fresh.select("inst"))).filter("kind < 0").select("inst", F.explode("pats").alias("pat"))
        beside = beside.groupBy("pat", "inst").agg(F.count(F.lit(1)).alias("c")).join(fresh, "inst")
        known = materialise(base.unionByName(beside.select("pat", "kind", "inst", (F.col("c") * F.col("conf")).alias("s"))))
    added = places.join(accepted.select("inst", "kind"), ["inst", "kind"])
    return added.select("doc_id", "rid", F.col("kind").cast("int").alias("kind"), "start", "stop").distinct()


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, rid, n_<kind> and base_spans of every row."""
    types = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            spans = []
            for _, text in _texts(b):
                found = base_spans(text)
                for k in range(BASE_KINDS):
                    counts[k].append(sum(x[0] == k for x in found))
                spans.append([{"kind": k, "start": s, "stop": e} for k, s, e in found])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(spans, types)],
                names=["doc_id", "rid", "n_email", "n_ip", "n_card", "n_phone", "base_spans"],
            )

    schema = "doc_id long, rid long, n_email long, n_ip long, n_card long, n_phone long, base_spans array<struct<kind:int,start:long,stop:long>>"
    return _rows(docs).mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """doc_id, base counts, base_spans and spans (arrays of kind number, start, stop, in that order) of every row.

    Null text counts as empty and has no spans; very long texts are read whole. Rows of the same id and text have the
    same spans, rows that repeat an id with another text have their own, a null id is an id. An empty table gives
    none. Added spans touch no base span.
    """
    more = materialise(bootstrap(docs, cfg))
    added = more.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added"))  # one text's
    base = _base(docs).alias("b")
    on = F.col("b.rid").eqNullSafe(F.col("a.rid")) & F.col("b.doc_id").eqNullSafe(F.col("a.doc_id"))
    rows = base.join(added.alias("a"), on, "left")
    spans = F.when(F.col("added").isNull(), F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", "added")))
    return rows.select("b.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", spans.alias("spans"))


def digests(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row, and n_secret and n_spans: how many spans
    of that kind, and in all, the row has. Rows and edge cases are those of find()."""
    out = find(docs, cfg)
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.encode(_joined(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == BASE_KINDS)).cast("long").alias("n_secret"),
        F.size("spans").cast("long").alias("n_spans"),
    )
