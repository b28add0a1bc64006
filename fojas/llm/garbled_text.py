"""Text that was decoded with the wrong encoding, found and restored by noisy-channel decoding.

A channel is a pair (encoding the bytes were read with, encoding they were written in), applied once
or twice. Under each channel a word with a character outside ASCII is a lattice of bytes: a character
stands for the bytes it was made from, and a lost one is a wildcard of one to three bytes. The lattice is
walked along the frequent words of the corpus, sorted by their bytes, so several lost bytes in a row may
be one character or more; the likeliest word that fits is taken if it is likelier than all others together.
A Viterbi search over the words of a value then chooses the channel of every word: words are
scored by their frequency in the corpus, unknown ones by how often their characters stand between
such neighbours, and each change of channel costs something, so damage comes in stretches.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas.plans.lineage import broadcast_if_small, written

LOST = "�"

# --- fixed values: encodings that texts are read with by mistake ---
#: UTF-8 text read as one of these.
_READ_AS = ("cp1252", "mac_roman", "cp1251", "cp850", "cp437", "cp1250")
#: (read as, written in) for encodings of one byte a character.
_ONE_BYTE = (("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"))
# --- end of fixed values ---

_TOKEN = re.compile(r"[^ \t\n\r]*[^\x00-\x7f \t\n\r][^ \t\n\r]*|[^ \t\n\r]*(?:[a-zA-Z]\?|\?[a-zA-Z])[^ \t\n\r]*")
_EDGE = r"^[\x00-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x40\x5b-\x60\x7b-\x7f]+$"
_EDGES = re.compile(_EDGE)
_EDGE_LEFT = re.compile(_EDGE.split("|")[0])
_LETTER = re.compile(r"[A-Za-z]")
_TELLING = re.compile(r"[^\x00-\x7f\u00a0]")
#: A byte may have been lost where a question mark touches a letter.
_INSIDE = re.compile(r"[a-zA-Z]\?[a-zA-Z]")
_MARK = re.compile(r"(?<=[a-zA-Z])\?|\?(?=[a-zA-Z])")


@dataclass(frozen=True)
class Channels:
    """Parameters of the search, as natural logarithms of probabilities."""

    enter: float = 3.0  #: a stretch begins in a channel of several bytes a character
    enter_one_byte: float = 3.5
    change: float = 6.0  #: from one channel to another
    unknown: float = 7.0  #: a word that isn't among the frequent ones
    wildcard: float = 2.0  #: a byte is missing
    capitals: float = 2.0  #: a word that is frequent in lower case only
    sure: float = 0.5  #: a word with lost bytes is restored if the likeliest that fits has more than this share of all that fit
    word_share: float = 1 / 200_000  #: words with this share, at most 200,000, are sent to all tasks; rarer ones are joined to the words that need them
    sign_share: float = 1 / 50_000  #: the same for (before, character, after): at most 50,000
    least: int = 8  #: a word seen less often counts as unknown


def _bytes_of(encoding: str) -> dict[str, int]:
    out = {chr(b): b for b in range(256)} if encoding == "cp1252" else {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    return out


#: An edge of a lattice: the UTF-8 bytes that a character stands for, or None for one to three lost ones.
Edges = list[bytes | None]


def plain_edges(word: str) -> Edges:
    return [None if c == LOST else c.encode("utf-8", "surrogatepass") for c in word]


def reading(edges: Edges) -> str:
    """The text of a lattice; where its bytes are lost or no text stands a mark."""
    return b"".join(LOST.encode() if e is None else e for e in edges).decode("utf-8", "replace")


def _reader(read_as: str, written_in: str, times: int = 1):
    """Two functions of a garbled word: its reading, and the lattice that this is read from; None where the channel can't have made it."""
    table = _bytes_of(read_as)
    if written_in == "utf-8":
        edge = {c: bytes([b]) for c, b in table.items()}
    else:
        edge = {c: None if (x := bytes([b]).decode(written_in, "replace")) == LOST else x.encode() for c, b in table.items()}

    quick = {ord(c): (LOST if e is None else e.decode("latin-1" if written_in == "utf-8" else "utf-8")) for c, e in edge.items()}
    possible = frozenset(edge) | {LOST}

    def once(word: str) -> str | None:
        if not possible.issuperset(word):
            return None
        new = word.translate(quick)  # bytes as characters for UTF-8, else the characters themselves
        return new if written_in != "utf-8" else new.encode("latin-1").decode("utf-8", "replace") if LOST not in new else reading(lattice(word))

    def lattice(word: str) -> Edges:
        return [None if c == LOST else edge[c] for c in word]

    def read(word: str) -> str | None:
        for i in range(times):
            new = once(word)
            if new is None or new == word or (i + 1 < times and LOST in new):
                return None
            word = new
        return word

    def edges(word: str) -> Edges:
        for _ in range(times - 1):
            word = once(word)
        return lattice(word)

    return read, edges


def channels() -> list[tuple]:
    """(name, whether one byte a character, the functions of :func:`_reader`)."""
    out = [(f"utf-8 as {e}", False, *_reader(e, "utf-8")) for e in _READ_AS]
    out += [(f"utf-8 as {e}, twice", False, *_reader(e, "utf-8", 2)) for e in ("cp1252", "cp1251", "mac_roman")]
    return out + [(f"{w} as {r}", True, *_reader(r, w)) for r, w in _ONE_BYTE]


def _kind(c: str) -> str:
    return "l" if c.islower() else "u" if c.isupper() else "a" if c.isalpha() else "d" if c.isdigit() else "e" if not c else "s" if c.isascii() else "o"


class _Kinds(dict):
    """:func:`_kind` of the characters seen."""

    def __missing__(self, c: str) -> str:
        self[c] = found = _kind(c)
        return found


_KINDS = _Kinds()
_OUTSIDE = re.compile(r"[^\x00-\x7f]")


def _signs(word: str) -> list[str]:
    """Each character outside ASCII with the kind of its neighbours."""
    return [_KINDS[word[i - 1 : i]] + word[i] + _KINDS[word[i + 1 : i + 2]] for i in (m.start() for m in _OUTSIDE.finditer(word))]


class _Lexicon:
    """Words sorted by their UTF-8 bytes; a run of them with one beginning is a node of their trie."""

    def __init__(self, words: dict[str, float]):
        pairs = sorted((w.encode("utf-8", "surrogatepass"), x) for w, x in words.items())
        self.words, self.scores = [w for w, _ in pairs], [x for _, x in pairs]

    def fits(self, edges: Edges) -> list[tuple[float, str]]:
        """(log probability, word) of the words on a path through the lattice, the likeliest first."""
        words, out = self.words, {}
        todo = [(0, 0, b"", 0, len(words))]  # edge, bytes of its wildcard so far, beginning, the run of words that have it
        while todo:
            k, held, begin, lo, hi = todo.pop()
            if k < len(edges) and edges[k] is not None:
                new = begin + edges[k]
                lo = bisect_left(words, new, lo, hi)
                hi = bisect_left(words, new + b"\xff", lo, hi)
                if lo < hi:
                    todo.append((k + 1, 0, new, lo, hi))
                continue
            if k == len(edges):
                if words[lo] == begin:
                    out[words[lo]] = self.scores[lo]
                continue
            if held:
                todo.append((k + 1, 0, begin, lo, hi))
            if held < 3:
                at = bisect_left(words, begin + b"\x80", lo, hi)
                while at < hi:
                    new = words[at][: len(begin) + 1]
                    end = bisect_left(words, new + b"\xff", at, hi)
                    todo.append((k, held + 1, new, at, end))
                    at = end
        return sorted(((x, w.decode("utf-8", "surrogatepass")) for w, x in out.items()), reverse=True)


class _Corpus:
    """Log probabilities of words and of characters between neighbours."""

    def __init__(self, words: dict[str, int], words_in_all: int, signs: dict[str, int], signs_in_all: int, p: Channels):
        self.p = p
        self.total = max(words_in_all, 1)
        self.word = {w: math.log(n / self.total) for w, n in words.items() if LOST not in w}
        self.sign = {s: math.log(n / max(signs_in_all, 1)) for s, n in signs.items()}
        self.no_sign = math.log(0.2 / max(signs_in_all, 50))
        self.lexicon = _Lexicon(self.word)
        self.rarer: dict[str, float] = {}

    def with_words(self, words: dict[str, int]) -> _Corpus:
        """The same with rarer words; lost bytes are still filled from the frequent ones."""
        new = object.__new__(_Corpus)
        new.__dict__ = self.__dict__ | {"rarer": {w: math.log(n / self.total) for w, n in words.items() if LOST not in w}}
        return new

    def known(self, bare: str) -> float | None:
        """Log probability of a known word, in capitals too; None of any other."""
        found = self.word.get(bare)
        if found is None and (low := bare.lower()) != bare and low in self.word:
            return self.word[low] - self.p.capitals
        if found is None and self.rarer:
            found = self.rarer.get(bare)
            if found is None and low in self.rarer:
                return self.rarer[low] - self.p.capitals
        return found

    def filled(self, edges: Edges) -> tuple[float, str] | None:
        """The likeliest word on the lattice and its log probability, in the case of the letters left; None if none or none surely fits."""
        if None not in edges:
            return None
        letters = b"".join(e for e in edges if e and e.isascii()).decode()
        if not any(c.isalpha() for c in letters):
            return None
        found, cost = self.lexicon.fits(edges), 0.0
        if not found and letters != letters.lower():
            low = [e.lower() if e and e.isascii() else e for e in edges]
            found, cost = self.lexicon.fits(low), self.p.capitals
            first = edges[0] is None or edges[0] != low[0]
            change = str.upper if letters.isupper() and (len(letters) > 1 or not first) else (lambda w: w[:1].upper() + w[1:]) if first else str
            found = [(x, change(w)) for x, w in found]
        if not found or math.exp(found[0][0]) <= self.p.sure * sum(math.exp(x) for x, _ in found):
            return None
        return found[0][0] - cost - self.p.wildcard * sum(e is None for e in edges), found[0][1]

    def score(self, token: str, edges: Edges | None = None) -> tuple[float, str]:
        """Log probability of a token, and the token with its lost bytes filled; ``edges``: its lattice, where it isn't the token's own."""
        bare = _EDGES.sub("", token)
        if not bare:
            return -0.5, token
        if LOST in bare:
            own = plain_edges(token) if edges is None else edges
            at = len(token) - len(_EDGE_LEFT.sub("", token))
            after = len(token) - at - len(bare)
            found = self.filled(own[at : len(own) - after])
            if found:
                return found[0], token[:at] + found[1] + token[len(token) - after :]
            return -self.p.unknown + sum(self.sign.get(s, self.no_sign) for s in _signs(bare.replace(LOST, "é"))) - 4 * bare.count(LOST), token
        known = self.known(bare)
        if known is not None:
            return known, token
        if bare.isascii():
            return -self.p.unknown - 2 * self.p.wildcard * bool(_INSIDE.search(bare)), token
        return -self.p.unknown + sum(self.sign.get(s, self.no_sign) for s in _signs(bare)), token


def _printed(text: str) -> bool:
    """Whether all characters are printed ones without spaces; no-break spaces and soft hyphens count as such."""
    return text.isalnum() or (rest := text.replace("\u00a0", "").replace("\u00ad", "")).isprintable() and " " not in rest


def _edge_marks_alone(token: str) -> bool:
    """Whether all characters outside ASCII are punctuation or spaces at the token's ends, where they stand in sound text, too."""
    i, j = 0, len(token)
    while i < j and (not token[i].isalnum() if token[i].isascii() else unicodedata.category(token[i])[0] in "PZ"):
        i += 1
    while j > i and (not token[j - 1].isalnum() if token[j - 1].isascii() else unicodedata.category(token[j - 1])[0] in "PZ"):
        j -= 1
    return token[i:j].isascii()


class _Tokens(dict):
    """By token: the score and reading under no channel and under each one, and the most that a reading can gain; kept up to a bound."""

    def __init__(self, corpus: _Corpus, ways: list):
        self.corpus, self.ways = corpus, ways

    def __missing__(self, t: str) -> tuple[list[tuple[float, str]], float]:
        corpus = self.corpus
        marked = _MARK.sub(LOST, t) if "?" in t else t
        s, filled = corpus.score(marked)
        plain = s if marked == t else corpus.score(t)[0]
        options = [(max(s, plain), filled if s > plain or LOST in t else t)]
        edges, letter, telling, lost, ascii_alone = _edge_marks_alone(t), _LETTER.search(t), _TELLING.search(t), LOST in t, t.isascii()
        no_text = (options[0][0] - 12.0, options[0][1])
        for _, one_byte, read, edges_of in self.ways:
            d = read(t)
            if d is None or not _printed(d):
                options.append(no_text if d is not None or not ascii_alone else options[0])
                continue
            known = letter and corpus.known(_EDGES.sub("", d)) is not None
            if not known and (not letter or not telling or (one_byte and edges)):
                # a sign alone, a no-break space or a mark beside an unknown word tells nothing, but shares its stretch's channel
                options.append((options[0][0], d))
            elif LOST not in d:
                options.append(corpus.score(d))
            else:
                # bytes that are no text in the other encoding: without a lost one among them (or where no known word fits) they stay so
                s, filled = corpus.score(d, edges_of(t)) if lost or one_byte else no_text
                options.append(no_text if LOST in filled else (s, filled))
        gain = math.inf if options[0][1] != t or LOST in t else max(o[0] for o in options) - options[0][0]
        if len(self) > 200_000:
            self.clear()
        self[t] = found = options, gain
        return found


class _OwnTokens:
    """Like :class:`_Tokens`, with the rarer words that belong to a few words of one value; all other tokens are shared."""

    def __init__(self, shared: _Tokens, rare: list[dict]):
        self.shared, self.corpus, self.ways = shared, shared.corpus, shared.ways
        self.bare = {x["word"] for x in rare}
        self.own = _Tokens(shared.corpus.with_words({x["other"]: x["n"] for x in rare}), shared.ways)

    def __getitem__(self, t: str) -> tuple[list[tuple[float, str]], float]:
        return (self.own if _EDGES.sub("", t) in self.bare else self.shared)[t]


def _words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _sound(text: str, tokens: _Tokens) -> bool:
    """Whether no path can be better than the text as it is: all gains together don't pay for entering a channel."""
    if text.isascii() and "?" not in text:
        return True
    most = min(tokens.corpus.p.enter, tokens.corpus.p.enter_one_byte)
    return sum(tokens[w][1] for w in _words(text) if not w.isascii() or ("?" in w and _MARK.search(w))) <= most


def _decode(text: str, tokens: _Tokens) -> tuple[str, list[str]]:
    """The restored text and the names of the channels used, without repeats; none for sound text."""
    p, ways = tokens.corpus.p, tokens.ways
    matches = list(_TOKEN.finditer(text))
    if not matches:
        return text, []
    n = len(ways) + 1
    enter = [0.0] + [p.enter_one_byte if one else p.enter for _, one, *_ in ways]
    best, back, seen = [0.0] + [-math.inf] * (n - 1), [], []
    for m in matches:
        options, _ = tokens[m.group()]
        top = max(range(n), key=best.__getitem__)
        new, came = [], []
        for k in range(n):
            stay = best[k]
            move = best[0] - enter[k] if k else best[top]
            if k and best[top] - p.change - enter[k] > move:
                move, source = best[top] - p.change - enter[k], top
            else:
                source = 0 if k else top
            if stay >= move:
                move, source = stay, k
            new.append(move + options[k][0])
            came.append(source)
        best = new
        back.append(came)
        seen.append(options)
    k = max(range(n), key=best.__getitem__)
    path = []
    for came in reversed(back):
        path.append(k)
        k = came[k]
    path.reverse()
    out, at, used = [], 0, []
    for m, k, options in zip(matches, path, seen, strict=True):
        new = options[k][1]
        out += [text[at : m.start()], new]
        at = m.end()
        if k and new != m.group():
            used.append(ways[k - 1][0])
        elif not k and (new != m.group() or LOST in m.group()):
            used.append("lost bytes")
    out.append(text[at:])
    return "".join(out), list(dict.fromkeys(used))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = Counter()
        for t in b.column(0).to_pylist():
            if not t.isascii():
                found.update(_EDGES.sub("", w) for w in _words(t) if not w.isascii())
        found.pop("", None)
        yield pa.record_batch({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def _sign_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: Counter = Counter()
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
            for s in _signs(w):
                found[s] += n
        yield pa.record_batch({"sign": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def _statistics(values: DataFrame, p: Channels) -> tuple[DataFrame, dict, int, dict, int]:
    """All words with characters outside ASCII, the frequent ones of them, and frequent characters by neighbours, over all values."""
    words = values.select("text").mapInArrow(_word_rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    common = {r["word"]: r["n"] for r in words.filter(F.col("n") >= max(p.least, total * p.word_share)).collect()}  # at most 1 / word_share rows
    signs = written(words.mapInArrow(_sign_rows, "sign string, n long").groupBy("sign").agg(F.sum("n").alias("n")), "signs")
    in_all = signs.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = {r["sign"]: r["n"] for r in signs.filter(F.col("n") >= max(1.0, in_all * p.sign_share)).collect()}  # at most 1 / sign_share rows
    return words, common, total, often, in_all


def _rarer(words: DataFrame, common: dict, total: int, p: Channels) -> DataFrame | None:
    """(word, other, n): words that are, or under a channel read as, another word of the corpus that is known but not frequent.

    None if every known word is frequent. The distinct words alone are read under the channels, and joined with all words.
    """
    if total * p.word_share <= p.least:
        return None
    frequent = words.sparkSession.sparkContext.broadcast(frozenset(common))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, ways = frequent.value, channels()
        for b in batches:
            word, other = [], []
            for w in b.column("word").to_pylist():
                read = {w} | {_EDGES.sub("", x) for _, _, way, _ in ways if (x := way(w)) is not None}
                for r in read | {r.lower() for r in read}:
                    if r and r not in have and LOST not in r:
                        word.append(w)
                        other.append(r)
            yield pa.record_batch({"word": pa.array(word, pa.string()), "other": pa.array(other, pa.string())})

    known = words.filter(F.col("n") >= p.least).select(F.col("word").alias("other"), "n")
    found = written(words.select("word").mapInArrow(others, "word string, other string").join(known, "other").select("word", "other", "n"), "known")
    # a word that can only be read as itself needs nothing
    read = found.filter("other <> word AND other <> lower(word)").select("word").distinct()
    return written(found.join(broadcast_if_small(written(read, "read")), "word", "left_semi"), "rarer")


def garbled_values(docs: DataFrame, id_col: str, text_cols: list[str], p: Channels = Channels()) -> DataFrame:
    """Values with at least one garbled stretch: (id_col, campo, restaurado string, canales array<string>).

    ``campo`` is the column's name, ``restaurado`` the value with every stretch restored that can be;
    ``canales`` the channels found. A stretch with lost bytes is found too; what no frequent word
    fits stays as it is. Corpus statistics are taken over all values of ``text_cols``.

    Null and empty values are never found; rows with a null id are left out; a repeated row is found
    once. Other columns are ignored. Values are read whole.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    wide = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(text_cols)])

    def tall(df: DataFrame) -> DataFrame:
        pair: list[Column] = [F.struct(F.lit(c).alias("campo"), F.col(f"v{i}").alias("text")) for i, c in enumerate(text_cols)]
        return df.select("id", F.explode(F.array(*pair)).alias("x")).select("id", "x.campo", "x.text").filter("id IS NOT NULL AND text IS NOT NULL AND text <> ''")

    values = tall(wide)
    words, *statistics = _statistics(values, p)
    sent = spark.sparkContext.broadcast(statistics)
    rarer = _rarer(words, *statistics[:2], p)
    values = values.withColumn("rare", F.lit(None).cast("array<struct<word:string,other:string,n:bigint>>")) if rarer is None else _with_rarer(values, rarer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, ways = _Corpus(*sent.value, p), channels()
        tokens = _Tokens(corpus, ways)
        for b in batches:
            out, keep, names = [], [], []
            for i, (t, rare) in enumerate(zip(b.column("text").to_pylist(), b.column("rare").to_pylist(), strict=True)):
                own = _OwnTokens(tokens, rare) if rare else tokens
                if _sound(t, own):
                    continue
                new, used = _decode(t, own)
                if used:
                    keep.append(i)
                    out.append(new)
                    names.append(used)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch(
                {"id": b.column("id").take(at), "campo": b.column("campo").take(at), "restaurado": pa.array(out, pa.string()), "canales": pa.array(names, pa.list_(pa.string()))}
            )

    found = values.mapInArrow(run, f"id {kind}, campo string, restaurado string, canales array<string>")
    return found.dropDuplicates(["id", "campo", "restaurado"]).withColumnRenamed("id", id_col)


def _with_rarer(values: DataFrame, rarer: DataFrame) -> DataFrame:
    """``values`` with the rarer words that their own words are or could be read as: + rare array<struct<word, other, n>>, null for most."""
    pairs = values.select("id", "campo", F.explode(_telling_words(F.col("text"))).alias("word"))
    found = pairs.join(broadcast_if_small(rarer), "word").groupBy("id", "campo").agg(F.collect_set(F.struct("word", "other", "n")).alias("rare"))
    return values.join(broadcast_if_small(written(found, "needed")), ["id", "campo"], "left")


def _telling_words(text: Column) -> Column:
    """The distinct words with a character outside ASCII, without what :data:`_EDGE` strips; that is ASCII alone, so other words go first."""
    some = F.filter(F.split(text, "[ \t\n\r]"), lambda w: F.octet_length(w) > F.char_length(w))
    return F.array_distinct(F.transform(some, lambda w: F.regexp_replace(w, _EDGE, "")))
