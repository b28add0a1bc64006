"""Combining sources so that each has a target share of all tokens.

Documents fall into cells by source, language and topic. Iterative proportional fitting rakes the
cells' tokens to the sources' target shares, and to the shares that languages and topics should have,
never beyond a source's cap of repetitions; a document's expected number of uses is its cell's fitted
tokens over the tokens it has. Within a source, from the largest document to the smallest, each is then
used that number of times rounded down or up, at random, where what the larger ones drew above or below
their expectation shifts the odds, so that the source ends close to its fitted tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas.llm.tokens import RANKS, token_counts
from fojas.plans.lineage import broadcast_if_small, written


@dataclass(frozen=True)
class Mix:
    """Parameters. A language or topic with a share below ``least_share`` falls into one rest, so each has at most 1 / least_share values."""

    total: int | None = None  #: tokens to draw; None: as many as let every source reach its share
    rounds: int = 200  #: at most; raking ends once no cell changes by more than ``settled``
    settled: float = 1e-9
    least_share: float = 0.005
    most_sources: int = 10_000  #: bound of the table of targets
    most_cells: int = 1_000_000  #: bound of the cells that the driver rakes
    group_rows: int = 50_000  #: documents that one task orders together
    seed: int = 5


def rake(have: np.ndarray, source: np.ndarray, language: np.ndarray, topic: np.ndarray, share: np.ndarray, cap: np.ndarray, total: float, rounds: int, settled: float = 0.0) -> np.ndarray:
    """Tokens to use of each cell: sources at ``share`` of ``total``, languages and topics at their shares in ``have``, none above its cap.

    Sources come last in every round, and what a cap holds back is spread over the source's other
    cells, so a source falls short only where all its cells are at their caps.
    """
    most = have * cap[source]
    x = np.minimum(have * (share * total / np.maximum(np.bincount(source, have, len(share)), 1e-9))[source], most)
    sides = [(k, np.bincount(k, have) / max(have.sum(), 1e-9)) for k in (language, topic)]
    for _ in range(rounds):
        before = x
        for key, want in sides:
            now = np.bincount(key, x, len(want))
            x = np.minimum(x * (want * x.sum() / np.maximum(now, 1e-9))[key], most)
        for _ in range(4):
            full = x >= most * (1 - 1e-12)
            held = np.bincount(source, np.where(full, x, 0), len(share))
            free = np.bincount(source, np.where(full, 0, x), len(share))
            grow = np.maximum(share * total - held, 0) / np.maximum(free, 1e-9)
            over = held > share * total * (1 + 1e-12)
            x = np.where(over[source], x * (share * total / np.maximum(held + free, 1e-9))[source], np.where(full, x, np.minimum(x * grow[source], most)))
        if np.all(np.abs(x - before) <= settled * np.maximum(have, 1)):
            break
    return x


def mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, language: Column, topic: Column, targets: DataFrame, p: Mix = Mix(), path: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """Uses of every text, and what every source reaches.

    ``targets`` has the columns source, share (positive numbers, scaled to 1) and cap (most uses of a
    text; null: 1). Returns ``uses (id, source, lang, topic, tokens bigint, uses int)``, with 0 for texts that are
    not used, and ``shares (source, target double, attainable double, cap int, limits boolean, texts bigint, tokens
    bigint, used bigint, reached double)``; :func:`margins` tells the shares of languages and topics.

    Without ``p.total`` the total is the largest that lets every source with text reach its share: that of the source for which
    ``limits`` is true. With it, sources may fall short, and ``reached`` says so. A source without text, or without a target, is
    never used; the shares of the former are spread over the others (``attainable``). Null languages
    and topics are values of their own. Null and empty texts have no tokens and are never used; rows
    with a null id are left out; repeated rows are texts of their own. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(language.cast("string"), F.lit("")).alias("lang"),
        F.coalesce(topic.cast("string"), F.lit("")).alias("topic"), F.col(text_col).alias("text"),
    ).filter("id IS NOT NULL")
    sized = written(token_counts(base, "text", "tokens", path), "sizes")
    goals = targets.filter("source IS NOT NULL AND share > 0").groupBy("source").agg(F.sum("share").alias("share"), F.coalesce(F.max("cap"), F.lit(1)).cast("int").alias("cap"))
    goals = goals.orderBy("source").limit(p.most_sources + 1).collect()
    if len(goals) > p.most_sources:
        raise ValueError(f"more than {p.most_sources} sources have targets")
    wanted = spark.createDataFrame([(g["source"],) for g in goals], "source string")
    able = sized.filter("tokens > 0").join(F.broadcast(wanted), "source")  # at most ``most_sources`` rows
    for c in ("lang", "topic"):
        some = sized.groupBy(c).agg(F.sum("tokens").alias("t"))
        all_tokens = sized.agg(F.sum("tokens").alias("t")).first()["t"] or 0
        common = [r[c] for r in some.filter(F.col("t") >= max(p.least_share * all_tokens, 1)).collect()]  # at most 1 / least_share rows
        able = able.withColumn(c, F.when(F.col(c).isin(common), F.col(c)).otherwise(F.lit("…")))
    cells = able.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("t")).orderBy("source", "lang", "topic").limit(p.most_cells + 1).collect()
    if len(cells) > p.most_cells:
        raise ValueError(f"more than {p.most_cells} cells of source, language and topic")
    names = [g["source"] for g in goals]
    share, cap = np.array([g["share"] for g in goals], float), np.array([g["cap"] for g in goals], float)
    code = lambda values: np.unique(np.array(values, dtype=object).astype(str), return_inverse=True)[1]
    number = {x: i for i, x in enumerate(names)}
    source = np.array([number[r["source"]] for r in cells], int)
    have = np.array([r["t"] for r in cells], float)
    tokens = np.bincount(source, have, len(names)) if len(cells) else np.zeros(len(names))
    share = np.where((tokens > 0) & (cap > 0), share, 0)
    share = share / max(share.sum(), 1e-12)
    rate, most = [], np.where(share > 0, tokens * cap / np.maximum(share, 1e-12), np.inf)
    if share.sum():
        total = float(p.total) if p.total is not None else float(most.min())
        fitted = rake(have, source, code([r["lang"] for r in cells]), code([r["topic"] for r in cells]), share, cap, total, p.rounds, p.settled)
        rate = [(r["source"], r["lang"], r["topic"], float(x / h)) for r, x, h in zip(cells, fitted, have, strict=True)]
    rates = spark.createDataFrame(rate, "source string, lang string, topic string, rate double")
    drawn = able.join(broadcast_if_small(rates), ["source", "lang", "topic"])  # one row for each cell
    per = able.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    drawn = drawn.join(broadcast_if_small(per), "source")
    group = F.pmod(F.xxhash64(F.lit(p.seed), "id"), F.ceil(F.col("rows") / p.group_rows)).alias("grp")
    chance = (F.pmod(F.xxhash64(F.lit(p.seed + 1), "id"), F.lit(1 << 30)) / float(1 << 30)).alias("chance")
    drawn = drawn.select("id", "source", "lang", "topic", "tokens", "rate", group, chance)

    def draw(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("chance").to_numpy(), -group.column("tokens").to_numpy()))
        group = group.take(pa.array(order))
        rate = group.column("rate").to_numpy() + 1e-9
        low = np.floor(rate)
        part = np.maximum(rate - low - 1e-9, 0.0)
        ahead, up = 0.0, np.zeros(len(rate))
        # each draw depends on all before it: small texts even out what large ones drew too much or too little
        for i, (share, limit, size) in enumerate(zip((part * group.column("tokens").to_numpy()).tolist(), (group.column("chance").to_numpy() * group.column("tokens").to_numpy()).tolist(), group.column("tokens").to_pylist(), strict=True)):
            ahead += share
            if share and ahead > limit:
                up[i], ahead = 1.0, ahead - size
        kept = [group.column(c) for c in ("id", "source", "lang", "topic", "tokens")]
        return pa.table([*kept, pa.array((low + up).astype(np.int32))], names=["id", "source", "lang", "topic", "tokens", "uses"])

    kind = docs.schema[id_col].dataType.simpleString()
    drawn = drawn.groupBy("source", "grp").applyInArrow(draw, f"id {kind}, source string, lang string, topic string, tokens long, uses int")
    rest = sized.join(F.broadcast(wanted), "source", "left_anti").unionByName(sized.filter("tokens = 0").join(F.broadcast(wanted), "source", "left_semi"))
    result = written(drawn.unionByName(rest.select("id", "source", "lang", "topic", "tokens", F.lit(0).alias("uses"))), "uses")
    reached = result.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("uses")).alias("used"))
    used_in_all = result.agg(F.sum(F.col("tokens") * F.col("uses")).alias("t")).first()["t"] or 0
    target = spark.createDataFrame(
        [(g["source"], float(g["share"]), float(a), int(g["cap"]), bool(p.total is None and np.isfinite(m) and m == most.min())) for g, a, m in zip(goals, share, most, strict=True)],
        "source string, target double, attainable double, cap int, limits boolean",
    )
    shares = F.broadcast(target).join(reached, "source", "left").select(
        "source", "target", "attainable", "cap", "limits", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("texts", "tokens", "used")],
        (F.coalesce("used", F.lit(0)) / F.lit(max(float(used_in_all), 1.0))).alias("reached"),
    )
    return result, shares


def margins(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """(side, value, target double, reached double): the shares of languages and topics in the texts of the targets' sources, and in what is used of them.

    Of the values with less than ``p.least_share`` of the tokens there is one row, "…".
    """
    own = uses.join(targets.filter("source IS NOT NULL AND share > 0").select("source").distinct(), "source", "left_semi").filter("tokens > 0")
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("value")) for c in ("lang", "topic")])).alias("x")
    used = own.select(sides, "tokens", (F.col("tokens") * F.col("uses")).alias("used")).groupBy("x.side", "x.value").agg(F.sum("tokens").alias("t"), F.sum("used").alias("u"))
    whole = own.agg(F.sum("tokens").alias("all"), F.sum(F.col("tokens") * F.col("uses")).alias("drawn"))  # one row
    return used.join(F.broadcast(whole)).select("side", "value", (F.col("t") / F.col("all")).alias("target"), F.coalesce(F.try_divide("u", "drawn"), F.lit(0.0)).alias("reached"))
