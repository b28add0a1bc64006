"""Sentence units of texts in many languages and scripts.

A text is first cut where a line can't go on in the next: at blank lines, and at single line ends
unless the text is wrapped and the line was full. In such a block, scripts with spaces get a lattice
of terminators: every terminator that could end a sentence is a node with a score (what stands before
and after it, abbreviations, ordinals, initials), a span between two nodes that would be no sentence
(a bare label, part of a quotation) costs more than any score, and the best path gives the units.

In scripts without spaces the gaps are found by terminators or, where a block has none of its script, by white
space; the words around a gap come from the best path through a lattice of dictionary words, and final
particles, connectives, opening words and the words' own habits at gaps say whether it divides (``spaceless``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fojas.llm.spaceless import HAS_LETTERS, IDEOGRAPHS, LETTERS, Gaps, Learning, after_gap, before_gap, learn

# --- fixed values: abbreviations (without the last period, lower case) ---
#: Never end a sentence.
_NEVER = frozenset(
    """sr sra srta sres dr dra lic licda ing arq prof profa gral cnel dir av avda edif of apto urb art arts núm nro nros pág págs párr vid cfr
    res vl vol cap lit ord ej ex p pp ob cit aprox máx mín tel
    mr mrs ms messrs st fig figs sec secs incl e.g i.e vs approx ch para paras viz cf ref
    lda.ª n.º mme mmes mlle me mm circ al chap
    abs nr ca mio mrd kl vgl bzw z.b d.h u.a ziff str hr fr bd
    ст стр ул им проф гл пп рис табл гг тыс млн см т.е
    κ κα κος δρ άρθρ παρ π.χ αρ αριθ σελ κεφ
    डॉ श्री पं प्रो
    أ.د""".split()
)
#: Bind only to a number that follows.
_NUMBERED = frozenset("no nos jan feb mar apr jun jul aug sep sept oct nov dec ene abr ago dic".split())
#: End a sentence only where the next word could open one.
_MAY_END = frozenset("etc usw s.a c.a s.l s.a.s s.r.l ltd inc corp co bros lda cía cia gmbh p.m a.m ss руб коп к.λπ κ.λπ jr".split())
#: Before an ordinal number with a period.
_ORDINAL = frozenset("der die das den dem des am vom zum beim im bis jeder jede ab seit".split())
# --- end of fixed values ---

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_FIRST = re.compile(r"[ \t]*([^ \t\r\n]+)")  # wrapping leaves no-break spaces alone
_SPACELESS = re.compile(HAS_LETTERS)
_GAP = re.compile(
    r"""([.!?…;\u037e؟।॥۔]+(?:[»”“"’')\]」』]+|[ \u00a0\u202f]»)*)\s+(?=\S)|([。！？…။។៕]+[」』”’）"»]*)\s*(?=\S)"""
    # the space is missing
    r"""|([.!?؟।](?<=[\w%)][\w%)].)[.!?]*[»”"’)]*)(?=[¿¡A-ZÀ-ÖØ-ÞΑ-ΫА-Яऄ-हء-ي][^\W\d_A-Z])"""
)
_GAP_THAI = re.compile(_GAP.pattern + rf"|(?<=[{LETTERS}0-9])()\s+(?=[{LETTERS}])")
_STOPS = re.compile("[။។៕]")
_QUOTE = re.compile(r"[«»“”„\"()（）「」『』\[\]]")
_CLOSES = {"»": "«", "”": "“", "）": "（", "」": "「", "』": "『", ")": "(", "]": "["}
_TOKEN = re.compile(r"[^\s(«“„\"\[¿¡'’]+$")
_ROMAN = r"(?:[IVXLCDM]+|[0-9]+)"
_LABEL = re.compile(
    rf"\s*(?:[-–—•*·]\s*)?(?:[^\s\d.,;:!?]{{1,14}}\.?\s+)?(?:[§№#]\s*)?{_ROMAN}(?:[.\-][0-9A-Za-z]{{1,3}})*\s*[.ºª°)\-:–]*\s*(?:[-–—]\s*)?"
)
_MARK = re.compile(r"\s*(?:[-–—•*·]|[a-zA-Z][.)]|\(?[a-z0-9]{1,3}\))\s*")
_LABEL_CHARS = 26
_OPENERS = "«“„\"(（「『[¿¡'‘-–—*•"


_UNLEARNT = Gaps()


def sentence_spans(text: str, gaps: Gaps = _UNLEARNT) -> list[tuple[int, int]]:
    """Offsets (start, end) of the units of a text; together they cover all but white space. ``gaps``: what was learnt of scripts without spaces."""
    out: list[tuple[int, int]] = []
    for lo, hi in _blocks(text):
        _units(text, lo, hi, out, gaps)
    return out


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that no unit leaves."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    width = _width(text, lines) if len(lines) > 1 else 0
    start = None
    for i, (lo, hi) in enumerate(lines):
        if start is None:
            start = lo
        if width and i + 1 < len(lines):
            last, nxt = len(text[lo:hi].strip()), _FIRST.match(text, *lines[i + 1])
            if nxt and last and last + 1 + len(nxt[1]) > width and (last >= 0.55 * width or nxt[1] < "⺀" or _LABEL.fullmatch(text, lo, hi)):
                continue
        yield start, hi
        start = None


def _width(text: str, lines: list[tuple[int, int]]) -> int:
    """The width at which a text was wrapped; 0 if it wasn't.

    Wrapped lines end just before the width, so of the lines that another line follows at once the
    90th part in a hundred is close to it, and hardly any text stands in longer lines.
    """
    size = [len(text[lo:hi].rstrip()) for lo, hi in lines]
    if sum(n for n in size if n > 110) > 0.2 * sum(size):
        return 0
    inner = sorted(n for n, after in zip(size, size[1:], strict=False) if n and after and n <= 110)
    if not inner:
        return 0
    width = inner[(len(inner) * 9) // 10 if len(inner) > 9 else -1]
    return width if 55 <= width <= 110 else 0


def _quotations(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets that are closed within the block."""
    spans: list[tuple[int, int]] = []
    open_: list[tuple[str, int]] = []
    for m in _QUOTE.finditer(text, lo, hi):
        c, i = m.group(), m.start()
        if c == '"':
            c = "”" if any(q == "“" for q, _ in open_) else "“"
        elif c == "“" and any(q == "„" for q, _ in open_):
            c = "„."
        if c in _CLOSES or c == "„.":
            want = "„" if c == "„." else _CLOSES[c]
            k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == want), None)
            if k is not None:
                j = open_[k][1]
                del open_[k:]
                while spans and spans[-1][0] > j:
                    spans.pop()
                spans.append((j, i))
        else:
            open_.append((c, i))
    return spans


def _opens(text: str, i: int, hi: int) -> int:
    """1 if what starts at i could open a sentence, 0 if it goes on, 2 if it is a number."""
    while i < hi and (text[i] in _OPENERS or text[i].isspace()):
        i += 1
    if i >= hi:
        return 1
    c = text[i]
    if c.islower():
        return int(i + 1 < hi and text[i + 1].isupper())  # like "iName"
    if c.isdigit():
        return 2
    return int(c.isalpha() or c in "§№#@$€" or not c.isascii())


def _score(text: str, lo: int, g: int, end: int, nxt: int, hi: int, unit: int, gaps: Gaps) -> int:
    """How surely the terminator at g (whose gap runs from end to nxt) ends a sentence: 2, 1 or 0 for not."""
    c = text[g]
    if c in "。！？":
        if text[end - 1] in "」』”’" and text[nxt] in "とっはのがをにでもな":
            return 0
        return 2
    if c in "।॥۔؟":
        return 2
    if c in "။។៕":
        return 0 if text.startswith("។ល។", g) else 2  # "etc."
    if c in ";;":
        return 2 if "Ͱ" <= text[g - 1] <= "Ͽ" or "ἀ" <= text[g - 1] <= "῿" else 0
    if c == "…" and g > lo and ("぀" <= text[g - 1] <= "鿿"):
        return 2 if nxt >= hi or gaps.closed_by(before_gap(text, lo, g)) else 0
    opens = _opens(text, nxt, hi)
    if not opens:
        return 0
    if c != "." or text[g + 1] in ".!?…":
        return 2
    if g > lo and text[g - 1].isspace():
        return 2
    m = _TOKEN.search(text, max(lo, g - 24), g)
    if not m:
        return 2
    token = m.group()
    low = token.lower()
    if end > g + 1:  # marks close after the period
        return 0 if low in _NEVER and text[end - 1] not in "»”“\"」" and opens == 0 else 2
    if low in _NEVER:
        return 0
    if low in _NUMBERED:
        return 1 if opens == 1 or not text[unit : m.start()].strip() else 0
    if low in _MAY_END:
        return int(opens == 1)
    size = len(token)
    if size == 1 and token.isalpha():
        before = text[max(lo, m.start() - 8) : m.start()].rstrip()
        if low == "г" and before[-1:].isdigit() or low == "m" and before[-2:] in ("p.", "a.") and token == "m" or low in "дп" and before[-2:] == "т.":
            return int(opens == 1)
        return 0
    if "." in token and token[0].isalpha() and size <= 6 and all(len(x) <= 2 for x in token.split(".")):
        return 0
    if size <= 2 and token.isdigit():
        before = text[max(lo, m.start() - 12) : m.start()].split()
        if before and before[-1].lower() in _ORDINAL:
            return 0
    return 2


def _units(text: str, lo: int, hi: int, out: list[tuple[int, int]], gaps: Gaps) -> None:
    while lo < hi and text[lo].isspace():
        lo += 1
    while hi > lo and text[hi - 1].isspace():
        hi -= 1
    if lo >= hi:
        return
    gap = _GAP_THAI if _SPACELESS.search(text, lo, hi) else _GAP
    # nodes: (end of the unit before, start of the unit after, best sum, node before)
    ends, starts, best, came = [lo], [lo], [0.0], [-1]
    quotes: list[tuple[int, int]] | None = None
    stops: bool | None = None
    closed: list[int] = []
    for m in gap.finditer(text, lo, hi):
        kind = m.lastindex
        g, end, nxt = m.start(), m.end(kind), m.end()
        if quotes is None:
            quotes = _quotations(text, lo, hi)
            closed = [j for _, j in quotes]
        if quotes:
            q = bisect_left(closed, end)
            if q < len(quotes) and quotes[q][0] < end:
                continue
        if kind == 4:
            if stops is None:
                stops = bool(_STOPS.search(text, lo, hi))
            if stops or gaps.binds(before_gap(text, lo, g), after_gap(text, nxt, hi)):
                continue
            score = 2
        else:
            score = _score(text, lo, g, end, nxt, hi, starts[-1], gaps)
            if not score:
                continue
        # the best node before: the last one, unless the span from there is a bare label
        k = len(best) - 1
        while k > 0 and end - starts[k] <= _LABEL_CHARS and _no_sentence(text, starts[k], end):
            k -= 1
        if end - starts[k] <= _LABEL_CHARS and _no_sentence(text, starts[k], end):
            continue
        total = best[k] + score
        if total <= best[-1] and k < len(best) - 1:
            continue
        ends.append(end)
        starts.append(nxt)
        best.append(total)
        came.append(k)
    k = len(best) - 1
    path = []
    while k > 0:
        path.append(k)
        k = came[k]
    at = lo
    for k in reversed(path):
        out.append((at, ends[k]))
        at = starts[k]
    if at < hi:
        out.append((at, hi))


def _no_sentence(text: str, lo: int, hi: int) -> bool:
    """Whether the span is only a label or a list mark."""
    return bool(_LABEL.fullmatch(text, lo, hi) or _MARK.fullmatch(text, lo, hi))


def sentences(docs: DataFrame, id_col: str, text_col: str, p: Learning = Learning()) -> DataFrame:
    """Units of every text: (id_col, inicio int, fin int), code points from 0, ``fin`` exclusive.

    The units of a text are in order, don't overlap, have no white space at either end and cover all
    else. Null, empty and blank texts have none; rows with a null id are left out; a text repeated
    under another id is treated as any other; a row repeated under one id gives its units once for
    each row. Texts of any length are read whole. Other columns are ignored. The words of scripts without spaces are learnt
    from all texts first; ``p`` bounds what is kept of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    learnt = learn(base.filter(F.col("text").rlike(f"[{LETTERS}{IDEOGRAPHS}]")).select("text"), _blocks, p)
    sent = docs.sparkSession.sparkContext.broadcast((learnt.words, learnt.opens, learnt.closes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = Gaps(*sent.value, p)
        for b in batches:
            at, lo, hi = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                spans = sentence_spans(t, gaps)
                at += [i] * len(spans)
                lo += [x for x, _ in spans]
                hi += [x for _, x in spans]
                if len(at) > 200_000:
                    yield _rows(b, at, lo, hi)
                    at, lo, hi = [], [], []
            yield _rows(b, at, lo, hi)

    found = base.mapInArrow(run, f"id {kind}, inicio int, fin int")
    return found.select(F.col("id").alias(id_col), "inicio", "fin")


def _rows(b: pa.RecordBatch, at: list[int], lo: list[int], hi: list[int]) -> pa.RecordBatch:
    return pa.record_batch({"id": b.column("id").take(pa.array(at, pa.int64())), "inicio": pa.array(lo, pa.int32()), "fin": pa.array(hi, pa.int32())})
