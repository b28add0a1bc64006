"""Words and gaps of scripts that put no spaces between words, learnt from the documents themselves.

The dictionary holds the stretches of characters that return often and whose neighbours vary on both sides; a run of letters is divided
into words by the likeliest path through the lattice of all of them. How often a word opens or ends a block of text, where no
sentence can go on, against how often it stands after or before white space inside one, tells whether such a gap divides sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fojas.plans.lineage import written

# --- fixed values: words at gaps (Thai, Lao, Khmer, Burmese; last line of the finals: Japanese, Chinese) ---
#: A gap before these words, or after them, doesn't end a sentence.
BINDS = frozenset(
    """และ หรือ แต่ ที่ ซึ่ง อัน โดย ว่า ของ กับ แก่ แด่ ต่อ เพื่อ ได้แก่ เช่น เป็น คือ ณ จาก ถึง ตาม
    ແລະ ຫຼື ແຕ່ ທີ່ ຊຶ່ງ ໂດຍ ວ່າ ຂອງ ກັບ ແກ່ ຕໍ່ ເພື່ອ ເຊັ່ນ ເປັນ ຄື ຈາກ ເຖິງ ຕາມ
    និង ឬ ប៉ុន្តែ ដែល ដោយ ថា របស់ ជាមួយ ដើម្បី ដូចជា ជា គឺ ពី ដល់ តាម
    နှင့် သို့မဟုတ် သော ဖြင့် ဟု ၏ အတွက် မှ သို့""".split()
)
#: These open a sentence.
OPENS = frozenset(
    """มาตรา ข้อ หมวด ในปี หาก ถ้า เมื่อ เนื่องจาก อย่างไรก็ตาม ทั้งนี้ นอกจากนี้
    ມາດຕາ ຖ້າ ເມື່ອ ເນື່ອງຈາກ ນອກຈາກນີ້
    មាត្រា ប្រសិនបើ នៅពេល លើសពីនេះ
    သို့သော် ထို့ကြောင့် ထို့ပြင်""".split()
)
#: These close one.
FINALS = frozenset(
    """ครับ ค่ะ คะ นะ แล้ว ไหม หรือไม่ ແລ້ວ ເດີ ບໍ່ ເນາະ ហើយ ទេ ណា တယ် မယ် ပြီ ဘူး လား
    か ね よ ぞ わ な た る す ない 吗 呢 吧 了 啊""".split()
)
LETTERS = "ก-๎ກ-ໍက-ဿក-៓"
IDEOGRAPHS = "ぁ-ヿ㐀-鿿"
#: Signs that belong to the letter before them, signs that stack the letter after them, vowels written before theirs.
_MARKS, _STACKS, _BEFORE = "ะ-ฺๅ-๎ະ-ຼ່-ໍါ-ှ឴-៓", "္្", "เ-ไເ-ໄ"
# --- end of fixed values ---
_FIXED = BINDS | OPENS | FINALS
_CLUSTER = re.compile(rf"[{_BEFORE}]?[^{_MARKS}{_BEFORE}](?:[{_STACKS}][^{_MARKS}]|[{_MARKS}])*|.", re.S)
_RUN = re.compile(rf"[{LETTERS}]+|[{IDEOGRAPHS}]+")
_INNER_GAP = re.compile(rf"(?<=[{LETTERS}0-9])\s+(?=[{LETTERS}])")
HAS_LETTERS = f"[{LETTERS}]"
_ANY = re.compile(HAS_LETTERS)
NUMBER = "0"


@dataclass(frozen=True)
class Learning:
    """Parameters of the dictionary."""

    clusters: int = 4  #: the longest word, in letters with their signs
    least: int = 4  #: a rarer stretch is no word
    share: float = 1 / 50_000  #: nor is one with a smaller share of its length's stretches: at most clusters / share words are sent to the tasks
    vary: float = 0.75  #: nor is one that is followed or preceded by the same letter in a larger share of its places
    smooth: float = 5.0  #: gaps of evidence that every word is given,
    prior: float = 0.3  #: of which this share divides
    divides: float = -2.0  #: a gap divides if the evidence of both sides adds up to more


class Gaps:
    """Words with their log probabilities, and the evidence (logarithms) of those that stand after or before a gap."""

    def __init__(self, words: dict[str, float] | None = None, opens: dict[str, float] | None = None, closes: dict[str, float] | None = None, p: Learning = Learning()):
        self.words, self.opens, self.closes, self.p = dict(words or {}), opens or {}, closes or {}, p
        self.unknown = min(self.words.values(), default=-14.0) - 4.0
        for w in _FIXED:
            self.words.setdefault(w, self.unknown + 6.0)
        self.longest = max(map(len, self.words))
        self.none = math.log(p.prior)
        self.cache: dict[str, list[str]] = {}

    def path(self, run: str) -> list[str]:
        """The words of a run: the likeliest path through the lattice; a letter that is in no word counts as one."""
        found = self.cache.get(run)
        if found is None:
            score, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
            for i in range(len(run)):
                for j in range(i + 1, min(len(run), i + self.longest) + 1):
                    x = self.words.get(run[i:j], self.unknown if j == i + 1 else None)
                    if x is not None and score[i] + x > score[j]:
                        score[j], back[j] = score[i] + x, i
            found, i = [], len(run)
            while i:
                found.append(run[back[i] : i])
                i = back[i]
            found.reverse()
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[run] = found
        return found

    def closed_by(self, left: str) -> bool:
        """Whether the last word of a run closes a sentence."""
        words = self.path(left)
        return bool(words) and words[-1] in FINALS

    def binds(self, left: str, right: str) -> bool:
        """Whether the gap between two runs (of letters, or :data:`NUMBER`) lies within one sentence."""
        before, after = (self.path(x) if x != NUMBER else [x] for x in (left, right))
        if not before or not after:
            return False
        if after[0] in OPENS or "".join(after[:2]) in OPENS or before[-1] in FINALS:
            return False
        if after[0] in BINDS or after[0][0] in "ๆฯໆ" or before[-1] in BINDS:
            return True
        return self.opens.get(after[0], self.none) + self.closes.get(before[-1], self.none) <= self.p.divides


def before_gap(text: str, lo: int, at: int, most: int = 48) -> str:
    """The run of letters that ends at ``at``, its last ``most`` characters; :data:`NUMBER` for digits; else empty."""
    if at > lo and text[at - 1].isdigit():
        return NUMBER
    found = None
    for found in _RUN.finditer(text, max(lo, at - most), at):
        pass
    return found.group() if found and found.end() == at else ""


def after_gap(text: str, at: int, hi: int, most: int = 48) -> str:
    """The run of letters that begins at ``at``, its first ``most`` characters."""
    found = _RUN.match(text, at, min(hi, at + most))
    return found.group() if found else ""


def _beginnings(run: str, p: Learning) -> list[str]:
    if run == NUMBER:
        return [run]
    c = _CLUSTER.findall(run)[: p.clusters]
    return ["".join(c[:k]) for k in range(1, len(c) + 1)]


def _endings(run: str, p: Learning) -> list[str]:
    if run == NUMBER:
        return [run]
    c = _CLUSTER.findall(run)[-p.clusters :]
    return ["".join(c[k:]) for k in range(len(c))]


def _counted(text_blocks: Callable[[str], Iterator[tuple[int, int]]], p: Learning):
    """From texts, rows (gram, head, tail, size, n, and how often it opens or closes a block, stands after or before a gap)."""

    def rows(runs: Counter, at: list[Counter]) -> pa.RecordBatch:
        grams: dict[str, list] = {}
        for r, n in runs.items():
            c = _CLUSTER.findall(r)
            for i in range(len(c)):
                for k in range(1, min(p.clusters + 1, len(c) - i) + 1):
                    g = "".join(c[i : i + k])
                    found = grams.get(g)
                    if found is None:
                        grams[g] = ["".join(c[i : i + k - 1]), "".join(c[i + 1 : i + k]), k, n]
                    else:
                        found[3] += n
        if at[1][NUMBER] or at[3][NUMBER]:
            grams[NUMBER] = ["", "", 1, at[1][NUMBER] + at[3][NUMBER]]
        found = [(g, *x, *(c[g] for c in at)) for g, x in grams.items()]
        columns = list(zip(*found, strict=True)) if found else [()] * 9
        kinds = [pa.string()] * 3 + [pa.int32()] + [pa.int64()] * 5
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gram", "head", "tail", "size", "n", "o", "c", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, at, held = Counter(), [Counter() for _ in range(4)], 0
            for t in b.column("text").to_pylist():
                runs.update(_RUN.findall(t))
                for lo, hi in text_blocks(t):
                    part = t[lo:hi].strip()
                    if not _ANY.search(part):
                        continue
                    at[0].update(_beginnings(after_gap(part, 0, len(part)), p))
                    at[1].update(_endings(before_gap(part, 0, len(part)), p))
                    for m in _INNER_GAP.finditer(part):
                        at[2].update(_beginnings(after_gap(part, m.end(), len(part)), p))
                        at[3].update(_endings(before_gap(part, 0, m.start()), p))
                held += len(t)
                if held > 500_000:  # bounds a task's memory
                    yield rows(runs, at)
                    runs, at, held = Counter(), [Counter() for _ in range(4)], 0
            yield rows(runs, at)

    return run


def learn(texts: DataFrame, text_blocks: Callable[[str], Iterator[tuple[int, int]]], p: Learning = Learning()) -> Gaps:
    """The dictionary and the evidence at gaps of ``texts (text)``, counted over all of them.

    ``text_blocks`` gives the stretches of a text that no sentence leaves. What reaches the driver is bounded by ``p.share``.
    """
    rows = texts.mapInArrow(_counted(text_blocks, p), "gram string, head string, tail string, size int, n long, o long, c long, a long, b long")
    sums = [F.sum(x).alias(x) for x in ("n", "o", "c", "a", "b")]
    grams = written(rows.groupBy("gram").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.first("size").alias("size"), *sums).filter(F.col("n") >= p.least), "grams")
    total = {r["size"]: r for r in grams.groupBy("size").agg(*[F.sum(x).alias(x) for x in ("n", "o", "c", "a", "b")]).collect()}  # a row for each length
    if not total:
        return Gaps(p=p)
    least = F.lit(0.0)
    for size, r in total.items():
        least = F.when(F.col("size") == size, F.lit(max(float(p.least), r["n"] * p.share))).otherwise(least)
    some = grams.filter((F.col("size") <= p.clusters) & (F.col("n") >= least))
    for side in ("head", "tail"):
        longer = grams.filter("size > 1").groupBy(F.col(side).alias("gram")).agg(F.max("n").alias(f"most_{side}"))
        some = some.join(longer, "gram", "left").filter((F.col("size") == 1) | (F.coalesce(f"most_{side}", F.lit(0)) <= p.vary * F.col("n")))
    words = some.select("gram", "n", "o", "c", "a", "b").collect()  # at most clusters / share rows
    one = total[1]
    logs = {r["gram"]: math.log(r["n"] / one["n"]) for r in words if r["gram"] != NUMBER}

    def evidence(edge: str, inner: str) -> dict[str, float]:
        if not one[edge] or not one[inner]:
            return {}
        base = one[edge] / one[inner]
        return {r["gram"]: math.log((r[edge] / base + p.smooth * p.prior) / (r[inner] + p.smooth)) for r in words if r[edge] or r[inner]}

    return Gaps(logs, evidence("o", "a"), evidence("c", "b"), p)
