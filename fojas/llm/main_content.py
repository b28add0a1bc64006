"""The main body of a page, by maximum-scoring subsequence.

Words and tags of every line carry weights: those of running text are positive, those of menus,
notices and other furniture, and the tags that stand for markup in extracted text (separators,
brackets, arrows, missing full stops, capitals), are negative. A line's score is the sum over its words and tags, since lines
are kept whole. A linear scan finds the stretch of lines with the largest sum, from the page's heading where that is known:
the page's body. The same scan with the sign turned finds the furniture that was laid into it.

The weights are a logistic regression fitted on a bounded sample of pages that label themselves, in whatever language or form:
lines that return across a site's pages, stand before the page's own heading (its title, the end of its breadcrumbs, or what
its address was made from) or after its last long sentence, or look like the titles of other pages, are furniture; the
heading is body; the rest is body of less trust, and is labelled again after each fit. How far
a single line may pull the sum down, and how much a run inside the body must weigh to go, are fitted on the same labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas.llm.repeated_lines import repeated_lines
from fojas.plans.lineage import broadcast_if_small, written


# --- fixed values: openings of lines that close or approve a norm ---
CLOSINGS = ("dado en", "visto bueno", "firma conforme", "comuníquese", "publíquese", "regístrese")
# --- end of fixed values ---


@dataclass(frozen=True)
class Body:
    """Parameters. ``pages`` bounds the labelled sample, the only rows that the driver sees."""

    pages: int = 2_000
    features: int = 1 << 16  #: hashed words and tags
    pages_of_feature: int = 8  #: a word or tag of fewer labelled pages has no weight
    steps: int = 120  #: gradient steps of a fit
    rate: float = 0.5
    keep: float = 1e-6  #: ridge
    trust: float = 0.25  #: weight of lines that are body only because nothing speaks against it
    rounds_of_labels: int = 4
    long_line: int = 70  #: characters of a line of running text
    floors: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0)  #: the lowest score of a line, when the region is sought: one of these,
    insides: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0)  #: and the least weight of a run that goes
    titles: float = 0.1  #: share of the titles that may look less like titles than the limit, before it is halved
    closings: tuple[str, ...] = CLOSINGS  #: lines that begin so are body, though they may return on every page; pages without them need none
    min_docs: int = 10


_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_NO_LETTERS = re.compile(r"[^a-z]+")
_MARKS = frozenset("|›>/»·[]{}→↑©@—<«:?¿…•%()")
_SENTENCE_ENDS = frozenset(".!?:;…。！？।؟።။។")


@dataclass
class Model:
    """What is fitted: weights of hashed features (the bias last), log odds of title-like runs of words, and three limits."""

    weights: np.ndarray
    title_odds: dict[str, float]
    title_limit: float
    floor: float = 1.0
    inside: float = 0.0


def _bare(line: str) -> str:
    return " ".join(line.lower().split())


def line_features(line: str, own: bool, titled: bool) -> list[str]:
    """Words and tags of a line; ``own``: it is the page's heading, ``titled``: it looks like the title of another."""
    low = _bare(line)
    found = _WORD.findall(low)
    words = [w for w in found if w[0].isalpha()]
    if not words:
        return ["<none>"]
    plain = ["0" if w[0].isdigit() else w for w in found]
    out = list(dict.fromkeys(w if w[0].isalpha() or w == "0" else "<" + w for w in plain if w[0].isalnum() or w in _MARKS))
    out += ["^" + words[0], "^" + " ".join(words[:2]), " ".join(words[-2:]) + "$", words[-1] + "$", "^^" + " ".join(plain[:3]), " ".join(plain[-3:]) + "$$"]
    out.append("<end" + (low[-1] if not low[-1].isalnum() else "0" if low[-1].isdigit() else "a"))
    out.append(f"<words{min(len(words), 40).bit_length()}")
    pieces = line.split()
    letters = [c for c in line if c.isalpha()]
    if line.isupper():
        out.append("<upper")
    elif letters[0].islower():
        out.append("<lower")
    if low.count(" | ") >= 2 and any(c.isdigit() for c in low):
        out.append("<row")
    if low[0].isdigit():
        out.append("<number")
    out.append(f"<capitals{4 * sum(w[0].isupper() for w in pieces) // len(pieces)}")
    if own:
        out.append("<own")
    elif titled:
        out.append("<title")
    return out


def _slug(text: str) -> str:
    return _NO_LETTERS.sub("-", text.lower()).strip("-")


def heading_at(lines: list[str], title: str | None, address: str | None) -> int:
    """The line that is the page's own heading: it equals the title, ends the breadcrumbs, or title or address is made from it; else -1."""
    low = [_bare(l) for l in lines]
    if title and (want := _bare(title)) in low:
        return low.index(want)
    for i, l in enumerate(low):
        if l.count(" ") >= 2 and any(len(x) > len(l) + 3 and x.endswith(l) for x in low[:i]):
            return i
    last = re.split(r"[?#]", address or "")[0].rstrip("/").rsplit("/", 1)[-1]
    for want in (_slug(title or ""), _slug(last)):
        if len(want) > 12:
            for i, l in enumerate(low):
                if _slug(l).startswith(want):
                    return i
    return -1


def _runs(line: str) -> list[str]:
    words = ["0" if w[0].isdigit() else w for w in _WORD.findall(_bare(line))]
    return list(dict.fromkeys(["^" + " ".join(words[:2]), *(f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False))]))


def _title_odds(titles: list[str], lines: list[str], share: float) -> tuple[dict[str, float], float]:
    """Log odds of runs of words that are more frequent in titles than in other lines, and the limit that titles reach."""
    inside, outside = Counter(r for t in titles for r in _runs(t)), Counter(r for l in lines for r in _runs(l))
    odds = {r: x for r, n in inside.items() if n >= max(5, 0.005 * len(titles)) and (x := log(n / len(titles) / ((outside[r] + 1) / len(lines)))) > 0}
    sums = sorted(sum(odds.get(r, 0.0) for r in _runs(t)) for t in titles)
    limit = sums[int(share * len(sums))] / 2 if sums else 0.0
    return odds, limit if limit > 0 else float("inf")


def _looks_like_title(line: str, odds: dict[str, float], limit: float) -> bool:
    return sum(odds.get(r, 0.0) for r in _runs(line)) >= limit


def _labels(lines: list[str], head: int, repeated: set[int], titled: list[bool], p: Body) -> list[int]:
    """1 body, 2 body if nothing speaks against it, 0 furniture, -1 blank."""
    closes = {i for i, l in enumerate(lines) if i > head and _bare(l).startswith(p.closings)} if p.closings else set()
    text = [
        i for i, l in enumerate(lines)
        if i in closes or i > head and (i + 1) not in repeated and not titled[i] and len(b := l.strip()) >= p.long_line and b[-1] in _SENTENCE_ENDS
    ]
    first = head if head >= 0 else text[0] if text else 0
    last = text[-1] if text else first
    out = []
    for i, l in enumerate(lines):
        if not l.strip():
            out.append(-1)
        elif i == head or i in closes:
            out.append(1)
        else:
            out.append(0 if (i + 1) in repeated or titled[i] or not first <= i <= last else 2)
    return out


def _hash(f: str, n: int) -> int:
    return xxhash.xxh32_intdigest(f) % n


def fit(pages: list[dict], p: Body) -> Model:
    """The model of some pages (text, title, address, repeated: numbers of lines); all weights are 0 if they have only one kind of line."""
    split = [x["text"].split("\n") for x in pages]
    heads = [heading_at(l, x["title"], x["address"]) for l, x in zip(split, pages, strict=True)]
    titles = [x["title"] for x in pages if x["title"] and len(x["title"].split()) > 1]
    odds, limit = _title_odds(titles, [l for ls, h in zip(split, heads, strict=True) for i, l in enumerate(ls) if i != h and l.strip()], p.titles)
    rows, cols, y, doubt, spans = [], [], [], [], []
    for lines, head, page in zip(split, heads, pages, strict=True):
        titled = [i != head and _looks_like_title(l, odds, limit) for i, l in enumerate(lines)]
        begin, own = len(y), -1
        for i, label in enumerate(_labels(lines, head, set(page["repeated"]), titled, p)):
            if label >= 0:
                own = len(y) - begin if i == head else own
                f = line_features(lines[i], i == head, titled[i])
                rows += [len(y)] * len(f)
                cols += [_hash(x, p.features) for x in f]
                y.append(int(label > 0))
                doubt.append(label == 2)
        spans.append((begin, len(y), own))
    model = Model(np.zeros(p.features + 1), odds, limit)
    if not y or not 0 < sum(y) < len(y):
        return model
    rows, cols, y, doubt = np.array(rows), np.array(cols), np.array(y, float), np.array(doubt)
    weight = (1 / np.sqrt(np.bincount(rows, minlength=len(y))))[rows]
    page_of = np.repeat(np.arange(len(spans)), [hi - lo for lo, hi, _ in spans])[rows]
    often = np.bincount(np.unique(page_of * p.features + cols) % p.features, minlength=p.features) >= min(p.pages_of_feature, max(1, len(pages) // 10))
    rows, cols, weight = (x[often[cols]] for x in (rows, cols, weight))
    for nth in range(p.rounds_of_labels):
        model.weights = _fit(model.weights, p.steps if nth == 0 else p.steps // 3, rows, cols, weight, y, np.where(doubt, p.trust, 1.0), p)
        z = np.bincount(rows, model.weights[cols] * weight, len(y)) + model.weights[-1]
        y[doubt] = z[doubt] > 0
        if not 0 < y.sum() < len(y):
            break
    wrong = {}
    for floor in p.floors:
        for inside in p.insides:
            kept = np.concatenate([body_lines(z[lo:hi].tolist(), own, floor, inside) for lo, hi, own in spans])
            wrong[floor, inside] = int((kept != (y > 0)).sum())
    model.floor, model.inside = min(wrong, key=wrong.get)
    return model


def _fit(w: np.ndarray, steps: int, rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, y: np.ndarray, trust: np.ndarray, p: Body) -> np.ndarray:
    """Logistic regression from the weights w on, with both labels of equal weight, by full gradients with a step per feature."""
    w, seen = w.copy(), np.full(p.features + 1, 1e-8)
    one, zero = trust @ y, trust @ (1 - y)
    share = trust * np.where(y > 0, 0.5 / max(one, 1), 0.5 / max(zero, 1))
    for _ in range(steps):
        z = np.bincount(rows, w[cols] * weight, len(y)) + w[-1]
        err = (1 / (1 + np.exp(-z)) - y) * share
        g = np.append(np.bincount(cols, err[rows] * weight, p.features), err.sum()) + p.keep * w
        seen += g * g
        w -= p.rate * g / np.sqrt(seen)
    return w


def best_run(scores: list[float], begin: int = -1) -> tuple[int, int]:
    """The contiguous run [lo, hi) with the largest sum, from ``begin`` if that isn't -1; the first and shortest of equals; empty if none is positive."""
    top, at, start, total = 0.0, (0, 0) if begin < 0 else (begin, begin + 1), max(begin, 0), 0.0
    for i in range(max(begin, 0), len(scores)):
        if begin < 0 and total <= 0:
            start, total = i, 0.0
        total += scores[i]
        if total > top:
            top, at = total, (start, i + 1)
    return at


def body_lines(scores: list[float], head: int, floor: float, inside: float) -> list[bool]:
    """Which lines are body: the best run without the runs of negative lines inside it that weigh more than ``inside``."""
    lo, hi = best_run([max(s, -floor) for s in scores], head)
    keep = [lo <= i < hi for i in range(len(scores))]
    i = lo if head < 0 else lo + 1
    while i < hi:
        j, total = i, 0.0
        while j < hi and scores[j] < 0:
            total -= scores[j]
            j += 1
        if total > inside:
            keep[i:j] = [False] * (j - i)
        i = max(j, i + 1)
    return keep


def page_furniture(pages: DataFrame, id_col: str, text_col: str, source: Column, title: Column | None = None, address: Column | None = None, p: Body = Body()) -> DataFrame:
    """Lines that don't belong to the body of their page: distinct (id_col, line_no int).

    Every row of ``pages`` is a page; ``source`` is a column expression that names its site; ``title`` and
    ``address``, where given, tell the page's heading from other lines (null: unknown). The
    model is fitted on at most ``p.pages`` pages, taken by the hash of their id.

    Null and empty texts and null ids have no lines; blank lines are never found; a page without any
    positive line and without a known heading is furniture throughout; if the labelled pages have one kind of line only, nothing
    can be told and nothing is found. A row repeated under one id counts once. Other columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    base = pages.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), source.alias("source"),
        (F.lit(None) if title is None else title).cast("string").alias("title"), (F.lit(None) if address is None else address).cast("string").alias("address"),
    ).filter("id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    often = repeated_lines(base, "id", "text", F.col("source"), p.min_docs)
    n = max(base.count(), 1)
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 0.9 * p.pages / n) * (1 << 30)))
    chosen = written(base.filter(share).select("id", "text", "title", "address").limit(p.pages), "chosen")  # at most ``pages`` rows
    few = chosen.select("id").distinct()
    lines = often.join(broadcast_if_small(few), "id", "left_semi").groupBy("id").agg(F.collect_set("line_no").alias("repeated"))
    sample = chosen.join(lines, "id", "left").select("text", "title", "address", F.coalesce("repeated", F.array()).alias("repeated")).toArrow()
    model = fit(sorted(sample.to_pylist(), key=lambda x: (x["text"], x["title"] or "", x["address"] or "")), p)
    if not model.weights.any():
        return base.select(F.col("id").alias(id_col), F.lit(0).alias("line_no")).limit(0)
    model.weights = model.weights.astype(np.float32)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        lines_seen = _Scores(m, p.features)
        for b in batches:
            at, no = [], []
            for i, (t, title, address) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "title", "address")), strict=True)):
                lines = t.split("\n")
                head = heading_at(lines, title, address)
                scores = [lines_seen.score(l, k == head) for k, l in enumerate(lines)]
                for k, (l, keep) in enumerate(zip(lines, body_lines(scores, head, m.floor, m.inside), strict=True), 1):
                    if not keep and l.strip():
                        at.append(i)
                        no.append(k)
            yield pa.record_batch({"id": b.column("id").take(pa.array(at, pa.int64())), "line_no": pa.array(no, pa.int32())})

    found = base.select("id", "text", "title", "address").mapInArrow(run, f"id {kind}, line_no int")
    return found.distinct().select(F.col("id").alias(id_col), "line_no")


class _Scores(dict):
    """Scores of lines that aren't their page's heading, kept up to a bound."""

    def __init__(self, m: Model, n: int):
        super().__init__()
        self.m, self.n, self.bias = m, n, float(m.weights[-1])
        self.weights: dict[str, float] = {}

    def score(self, line: str, own: bool) -> float:
        return self.summed(line_features(line, True, False)) if own else self[line]

    def summed(self, features: list[str]) -> float:
        total, w = 0.0, self.weights
        for f in features:
            x = w.get(f)
            if x is None:
                if len(w) > 500_000:
                    w.clear()
                x = w[f] = float(self.m.weights[_hash(f, self.n)])
            total += x
        return total / len(features) ** 0.5 + self.bias

    def __missing__(self, line: str) -> float:
        if len(self) > 100_000:
            self.clear()
        found = 0.0
        if line.strip():
            found = self.summed(line_features(line, False, _looks_like_title(line, self.m.title_odds, self.m.title_limit)))
        self[line] = found
        return found


def main_content(pages: DataFrame, id_col: str, text_col: str, source: Column, title: Column | None = None, address: Column | None = None, p: Body = Body()) -> DataFrame:
    """``pages`` with only the body's lines in ``text_col``; every row and column stays, null texts stay null."""
    lost, at = "furniture_lines", "furniture_id"
    while {lost, at} & set(pages.columns):
        lost, at = lost + "_", at + "_"
    lines = page_furniture(pages, id_col, text_col, source, title, address, p).groupBy(F.col(id_col).alias(at)).agg(F.collect_set("line_no").alias(lost))
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(F.col(lost), i + F.lit(1)))
    new = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return pages.join(lines, pages[id_col] == lines[at], "left").withColumn(text_col, new).select(*pages.columns)
