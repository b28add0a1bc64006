"""The registered queries of the core: each reads whole tables of a folder. Their SQL counterparts are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fojas.functions import entities, text, urls, vectors
from fojas.operators import answer, approximate, chunking, dense, evaluate, filters, fusion, index, lexical, rerank, scan, search
from fojas.oracles import FORMS, oracle_sql

__all__ = ["oracle_sql", "queries"]

DIM = 32
_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _found[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def _t(s: SparkSession, sf: str, name: str) -> DataFrame:
    return s.read.parquet(f"{sf}/{name}.parquet")


def _asked(s: SparkSession, sf: str) -> DataFrame:
    """The queries of the evaluation set, each once: (qid, query)."""
    return _t(s, sf, "eval_set").filter("query IS NOT NULL").select(F.md5("query").alias("qid"), "query").distinct()


def _relevant(s: SparkSession, sf: str) -> DataFrame:
    return _t(s, sf, "eval_set").filter("query IS NOT NULL").select(F.md5("query").alias("qid"), F.col("doc_id_relevante").alias("doc_id")).distinct()


def _lexical(s: SparkSession, sf: str) -> DataFrame:
    ix = lexical.build_index(_t(s, sf, "normativa"), "pos", "texto")
    return lexical.scores(ix, _asked(s, sf), "qid", "query")


def _index(s: SparkSession, sf: str) -> lexical.Index:
    return lexical.build_index(_t(s, sf, "normativa"), "pos", "texto")


def _best_words(s: SparkSession, sf: str, k: int) -> DataFrame:
    return lexical.best_of(_index(s, sf), _asked(s, sf), "qid", "query", k)


def _encoded(s: SparkSession, sf: str, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """Hashed vectors of the objects (pos, vector) and of the queries (qid, vector)."""
    base = _t(s, sf, "normativa").select("pos", vectors.hash_encode(F.col("texto"), dim).alias("vector")).filter(F.exists("vector", lambda x: x != 0))
    return index.written(base, "vectors"), _encoded_asked(s, sf, dim)


def _encoded_asked(s: SparkSession, sf: str, dim: int = DIM) -> DataFrame:
    asked = _asked(s, sf).select("qid", vectors.hash_encode(F.col("query"), dim).alias("vector")).filter(F.exists("vector", lambda x: x != 0))
    return index.written(asked, "asked")


def _both(s: SparkSession, sf: str, keep: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, float]:
    """Rows, queries and mean length for a scan by words and hashed vectors; a text is read once for both."""
    ix = lexical.build_index(_t(s, sf, "normativa"), "pos", "texto", DIM, keep)
    return ix.documents, fusion.asked_parts(ix, _asked(s, sf), _encoded_asked(s, sf)), ix.mean_length


def _hybrid(s: SparkSession, sf: str, alpha: float) -> DataFrame:
    if alpha == 1:  # words have no weight
        rows = index.written(lexical.documents(_t(s, sf, "normativa"), "pos", "texto", DIM, words=False), "vectors")
        return _shown(fusion.best_fused(rows, _encoded_asked(s, sf), alpha, 10, 1.0))
    rows, asked, mean = _both(s, sf)
    return _shown(fusion.best_fused(rows, asked, alpha, 10, mean))


def _documents(s: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return index.written(rows.join(_t(s, sf, "normativa").select("pos", F.col("doc_id").alias("doc")), "pos"), "rows")


def _top(scored: DataFrame, k: int = 10) -> DataFrame:
    return _shown(lexical.best(scored, k))


def _shown(top: DataFrame) -> DataFrame:
    return top.select("qid", "pos", F.col("nth").cast("long").alias("nth"), F.round("score", 4).alias("score"))


# text


@_query
def norm_whitespace(s, sf):
    return _t(s, sf, "extracted").select("doc_id", text.normalize_lines(F.col("texto")).alias("texto")).distinct()


@_query
def squeeze_blank_lines(s, sf):
    return _t(s, sf, "documents").select("doc_id", text.sha256(text.squeeze_blank_lines(F.col("text"))).alias("h"))


@_query
def sha_text(s, sf):
    h = text.sha256(F.col("texto"))
    return _t(s, sf, "chunks_ner").select("doc_id", "chunk_index", h.alias("h"), (h == F.col("doc_hash")).alias("igual")).distinct()


@_query
def tokenize(s, sf):
    return _t(s, sf, "normativa").select("pos", F.array_join(text.tokens(F.col("texto")), " ").alias("terminos"))


@_query
def first_date(s, sf):
    return _t(s, sf, "extracted").select("doc_id", text.first_date(F.col("texto")).alias("fecha")).distinct()


@_query
def infer_type(s, sf):
    t = _t(s, sf, "extracted")
    return t.select("doc_id", text.infer_kind(F.col("fuente_url"), F.col("titulo")).alias("tipo")).distinct()


@_query
def infer_subject(s, sf):
    t = _t(s, sf, "extracted")
    return t.select("doc_id", text.infer_subject(F.col("fuente_url"), F.col("titulo")).alias("materia")).distinct()


@_query
def index_properties(s, sf):
    p = text.index_properties()
    return _t(s, sf, "chunks_ner").select(*[c.alias(k) for k, c in p.items() if k != "entidades"], F.size(p["entidades"]).alias("n_entidades")).distinct()


@_query
def compact_corpus(s, sf):
    return index.compact_corpus(_t(s, sf, "chunks_ner")).select("doc_id", "titulo", "seccion", "tipo_norma", "materia", "fuente_url", "texto").distinct()


@_query
def min_length(s, sf):
    n = F.length("texto")
    return _t(s, sf, "extracted").select("doc_id", (F.coalesce(n, F.lit(0)) >= 40).alias("extraible"), (n > 200).alias("evaluable"), F.substring("texto", 1, 420).alias("cita")).distinct()


@_query
def clean_secret(s, sf):
    return _t(s, sf, "registro_consultas").select("consulta", text.clean_secret(F.concat(F.lit(' "`'), "consulta", F.lit("'  "))).alias("limpia")).distinct()


# links and pages


@_query
def url_slug(s, sf):
    u = F.col("fuente_url")
    return _t(s, sf, "extracted").filter("fuente_url IS NOT NULL").select(
        "fuente_url", urls.slug(u).alias("nombre"), urls.site_of(u).alias("sitio"), urls.is_document(u).alias("documento"), urls.followed(u, ["/fondo/", "/pagos/"]).alias("seguida")
    ).distinct()


def _folders(s, sf):
    """Links from every folder of an address to the next: (desde, hasta)."""
    u = _t(s, sf, "extracted").filter("fuente_url IS NOT NULL").select(F.concat(urls.site_of(F.col("fuente_url")), urls.path_of(F.col("fuente_url"))).alias("u")).filter("u IS NOT NULL").distinct()
    parts = u.select(F.split(F.regexp_replace("u", "/+$", ""), "/").alias("p")).filter(F.size("p") > 1)
    step = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i"))
    return step.select(F.array_join(F.slice("p", F.lit(1), F.col("i")), "/").alias("desde"), F.array_join(F.slice("p", F.lit(1), F.col("i") + 1), "/").alias("hasta")).distinct()


@_query
def link_closure(s, sf):
    links = index.written(_folders(s, sf), "links")
    seeds = links.filter(~F.contains("desde", F.lit("/"))).select(F.col("desde").alias("url"))
    return index.link_closure(links, seeds)


@_query
def html_tree_text(s, sf):
    from fojas.sources.html import html_texts

    safe = F.replace(F.replace(F.replace("texto", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit('<html><head><title>x</title></head><body><nav>Inicio</nav><div class="main-menu"><p>Menú</p></div><main><script>var a;</script><p>'),
        F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></main><footer>Pie</footer></body></html>"),
    )
    pages = _t(s, sf, "extracted").filter("formato = 'html' AND texto IS NOT NULL").select("doc_id", page.alias("html")).distinct()
    return html_texts(pages, "doc_id", "html")


@_query
def link_extract(s, sf):
    from fojas.sources.html import html_links

    body = F.concat(F.lit('<a href="#x">x</a><a href="mailto:a@b">y</a><p><a href="'), "hash", F.lit('">z</a><a href="/doc/'), "id", F.lit('.pdf">d</a><a href="https://otro.example/">o</a>'))
    pages = _t(s, sf, "paginas").filter("estado = 'ok' AND url IS NOT NULL AND hash IS NOT NULL AND id IS NOT NULL").select(
        F.concat(F.lit("https://"), urls.site_of(F.col("url")), F.lit("/")).alias("u"), body.alias("html")
    ).filter("u IS NOT NULL")
    return html_links(pages, "u", "html").distinct()


@_query
def captures_latest(s, sf):
    """The manifest with one row a page: the last capture that succeeded."""
    ok = _t(s, sf, "paginas").filter("estado = 'ok' AND id IS NOT NULL").distinct()
    return ok.groupBy("id").agg(F.max(F.struct("fecha_captura", "hash")).alias("x"), F.count(F.lit(1)).alias("capturas")).select("id", "x.fecha_captura", "x.hash", "capturas")


# pieces


@_query
def chunk_by_size(s, sf):
    return chunking.size_windows(_t(s, sf, "documents"), "doc_id", "text")


@_query
def chunk_structural(s, sf):
    docs = _t(s, sf, "extracted").select("doc_id", "titulo", "fuente_url", "tipo_norma", "materia", "formato", "texto").distinct()
    return chunking.chunks(docs)


@_query
def hierarchy_context(s, sf):
    docs = _t(s, sf, "extracted").filter("texto IS NOT NULL").select("doc_id", "texto").distinct().groupBy("doc_id").agg(F.min("texto").alias("texto"))
    lines = docs.select("doc_id", F.posexplode(F.split("texto", "\n", -1)).alias("i", "linea"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = lines
    for name, pattern in (("titulo", "t[íi]tulo"), ("capitulo", "cap[íi]tulo"), ("seccion", "secci[óo]n")):
        mark = F.nullif(F.regexp_extract("linea", rf"^[ \t]*(?iu:{pattern})[ \t]+([IVXLCDM]+|[0-9]+)[ \t]", 1), F.lit(""))
        out = out.withColumn(name, F.last(mark, ignorenulls=True).over(w))
    return out.filter(F.col("linea").rlike(r"^[ \t]*(?iu:art[íi]culo|art\.)[ \t]*[0-9]+")).select("doc_id", (F.col("i") + 1).alias("linea_no"), "titulo", "capitulo", "seccion")


# entities


@_query
def entities_rules(s, sf):
    return _t(s, sf, "normativa").select("pos", F.array_join(entities.rule_entities(F.col("texto")), "|").alias("entidades"))


@_query
def entities_canonical(s, sf):
    return _t(s, sf, "chunks_ner").select("doc_id", "chunk_index", F.array_join(entities.canonical(F.col("entidades")), "|").alias("entidades")).distinct()


@_query
def entities_ensemble(s, sf):
    both = entities.ensemble(entities.rule_entities(F.col("texto")), F.col("entidades"))
    return _t(s, sf, "chunks_ner").select("doc_id", "chunk_index", F.array_join(both, "|").alias("entidades")).distinct()


@_query
def entity_filter_any(s, sf):
    where = filters.build_filter({"entidades": ["institucion:ministerio", "periodo:enero"], "tipo_norma": "Ley"})
    return _t(s, sf, "normativa").filter(where).select("pos", "doc_id")


@_query
def date_range_filter(s, sf):
    where = filters.build_filter({"fecha_desde": "2005-01-01", "fecha_hasta": "2015-12-31T00:00:00Z"})
    return _t(s, sf, "normativa").filter(where).select("pos", "fecha_publicacion")


def _tagged(s, sf):
    return _t(s, sf, "chunks_ner").dropDuplicates(["doc_id", "chunk_index"])


@_query
def tagger_coverage(s, sf):
    return evaluate.tagger_volume(_tagged(s, sf), ["tipo_norma"])


@_query
def tagger_recall(s, sf):
    stems = [("Resolución", "resoluc"), ("Circular", "circular"), ("Convenio cambiario", "convenio"), ("Decreto", "decreto"), ("Ley", "ley"), ("Aviso oficial", "aviso")]
    return evaluate.tagger_recall(_tagged(s, sf), stems, "tipo_de_norma")


@_query
def tagger_oov_top(s, sf):
    """The given entities that nothing the rules find in the texts explains."""
    def values(e):
        split = (F.substring_index("e", ":", 1).alias("etiqueta"), F.lower(F.expr("substring(e, instr(e, ':') + 1)")).alias("valor"))
        return _tagged(s, sf).select(F.explode(e).alias("e")).select(*split)

    return evaluate.unknown_values(values(entities.canonical(F.col("entidades"))), values(entities.rule_entities(F.col("texto"))))


@_query
def tagger_forms(s, sf):
    """How many texts with a written form are tagged with it, by the rules and by the given entities."""
    return evaluate.form_coverage(_tagged(s, sf), FORMS, {"reglas": entities.rule_entities(F.col("texto")), "dadas": F.col("entidades")})


@_query
def stratified_sample(s, sf):
    key = F.concat_ws("|", "doc_id", F.col("chunk_index").cast("string"))
    return evaluate.stratified_sample(_tagged(s, sf), F.coalesce("tipo_norma", F.lit("")), key, 15).select("estrato", "doc_id", "chunk_index")


# the index


@_query
def dedupe_hash(s, sf):
    docs = _t(s, sf, "extracted").select("doc_id", "formato", "hash").distinct()
    return index.unique_documents(docs)


@_query
def incremental_pending(s, sf):
    pieces = _t(s, sf, "chunks_ner").select("doc_id", "chunk_index", "doc_hash").distinct()
    return index.pending(pieces, _t(s, sf, "normativa").select("doc_hash"), [F.col("doc_id"), F.col("chunk_index")])


@_query
def align_vectors_by_text(s, sf):
    pieces = _t(s, sf, "chunks_ner").select("doc_id", "chunk_index", "texto").distinct()
    found, _ = index.vectors_by_text(pieces, _t(s, sf, "normativa").select("pos", "texto", "vector"))
    return found.select("doc_id", "chunk_index", F.round(F.element_at("vector", 1).cast("double"), 4).alias("primero"))


@_query
def systematic_sample(s, sf):
    """At most 500 pieces at equal steps of their order, for a check of the whole index at a bounded cost."""
    pieces = _t(s, sf, "chunks_ner").select("doc_id", "chunk_index").distinct()
    return index.systematic_sample(pieces, [F.col("doc_id"), F.col("chunk_index")], 500)


@_query
def schema_rows(s, sf):
    return index.schema_rows(_t(s, sf, "normativa"))


@_query
def vector_checks(s, sf):
    return index.vector_checks(_t(s, sf, "normativa"))


@_query
def alignment_guard(s, sf):
    objects = _t(s, sf, "normativa")
    return search.aligned(objects.select("pos"), objects.filter(vectors.usable(F.col("vector"), 128)).select("pos"))


@_query
def facet_catalog(s, sf):
    return index.facets(_t(s, sf, "normativa"), ["materia", "tipo_norma"])


@_query
def facets_documents(s, sf):
    return index.facets(_t(s, sf, "documents"), ["lang", "source", "materia", "tipo_norma"])


@_query
def stats(s, sf):
    return _t(s, sf, "normativa").agg(
        F.count(F.lit(1)).alias("objetos"), F.countDistinct("doc_id").alias("documentos"), F.countDistinct("doc_hash").alias("hashes"),
        F.count_if(F.size(F.coalesce("entidades", F.array().cast("array<string>"))) > 0).alias("con_entidad"), F.count("fecha_publicacion").alias("con_fecha"),
        F.round(F.avg(F.length("texto")), 4).alias("largo_medio"),
    )


@_query
def chunk_counts(s, sf):
    return _tagged(s, sf).groupBy("estrategia", "formato").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("texto")).alias("caracteres"))


# lexical search


@_query
def index_stats(s, sf):
    return lexical.corpus_size(_t(s, sf, "normativa"), "texto").select("n", F.round("mean_length", 4).alias("mean_length"))


@_query
def term_df(s, sf):
    return lexical.postings(_t(s, sf, "normativa"), "pos", "texto").filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("f").alias("f"))


@_query
def doc_lengths(s, sf):
    return _t(s, sf, "normativa").select("pos", F.greatest(F.size(text.tokens(F.col("texto"))), F.lit(1)).alias("dl"))


@_query
def bm25_topk(s, sf):
    return _shown(_best_words(s, sf, 10))


@_query
def bm25_filtered(s, sf):
    objects = _t(s, sf, "normativa")
    allowed = objects.filter(filters.build_filter({"tipo_norma": "Ley"})).select("pos")
    return _shown(lexical.best_of(_index(s, sf), _asked(s, sf), "qid", "query", 5, allowed))


@_query
def bm25_log(s, sf):
    """The best five objects for every distinct query of the log."""
    asked = _t(s, sf, "registro_consultas").filter("consulta IS NOT NULL").select(F.md5("consulta").alias("qid"), F.col("consulta").alias("query")).distinct()
    return _shown(lexical.best_of(_index(s, sf), asked, "qid", "query", 5))


# dense search


@_query
def l2_normalize(s, sf):
    v = vectors.l2_normalize(F.col("vector"))
    return _t(s, sf, "normativa").filter(vectors.usable(F.col("vector"), 128)).select("pos", *[F.round(F.element_at(v, i), 5).alias(f"v{i}") for i in (1, 64, 128)])


@_query
def dense_topk(s, sf):
    """The five nearest others of every object whose pos is divisible by 20, exactly."""
    usable = _t(s, sf, "normativa").filter(vectors.usable(F.col("vector"), 128)).select("pos", "vector")
    asked = usable.filter("pos % 20 = 0").withColumnRenamed("pos", "qid")
    return _top(dense.cosine_scores(usable, asked, 6).filter("qid <> pos"), 5)


@_query
def embeddings_topk(s, sf):
    base = _t(s, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    asked = base.filter("pos % 20 = 0").withColumnRenamed("pos", "qid")
    return _top(dense.cosine_scores(base, asked, 6).filter("qid <> pos"), 5)


@_query
def ann_topk(s, sf):
    """As dense_topk, from the inverted lists nearest to each query; recall is measured in the tests."""
    usable = _t(s, sf, "normativa").filter(vectors.usable(F.col("vector"), 128)).select("pos", "vector")
    asked = usable.filter("pos % 20 = 0").withColumnRenamed("pos", "qid")
    return _top(approximate.nearest(approximate.build_lists(usable), asked, 6).filter("qid <> pos"), 5)


@_query
def hash_encode(s, sf):
    e = _t(s, sf, "normativa").select("pos", F.posexplode(vectors.hash_encode(F.col("texto"), DIM)).alias("cubo", "n"))
    return e.filter("n > 0").select("pos", "cubo", F.col("n").cast("long").alias("n"))


# fusion


@_query
def hybrid_linear(s, sf):
    return _hybrid(s, sf, 0.7)


@_query
def hybrid_alpha0(s, sf):
    return _hybrid(s, sf, 0.0)


@_query
def hybrid_alpha1(s, sf):
    return _hybrid(s, sf, 1.0)


@_query
def hybrid_rrf(s, sf):
    rows, asked, mean = _both(s, sf)
    found = fusion.best_reciprocal(rows, asked, 10, mean)
    return found.select("qid", "pos", F.col("nth").cast("long").alias("nth"), F.round("score", 6).alias("score"))


@_query
def candidate_union(s, sf):
    rows, asked, mean = _both(s, sf)
    found = index.written(scan.best(rows, asked, ["word", "cosine"], 20, mean), "found")
    return fusion.candidates(*[lexical.best(found.filter(F.col("kind") == i), 20) for i in (0, 1)])


# second stage


@_query
def two_stage_search(s, sf):
    top = _best_words(s, sf, 30).join(_t(s, sf, "normativa").select("pos", "texto"), "pos").join(_asked(s, sf), "qid")
    found = rerank.rerank(top, "query", "texto", 5)
    return found.select("qid", "pos", F.col("place").cast("long").alias("place"), "rerank_score")


@_query
def rerank_align_missing(s, sf):
    """Candidates aligned with a service that returned every second score."""
    top = index.written(_best_words(s, sf, 10), "top")
    returned = top.filter("nth % 2 = 0").select("qid", "nth", F.col("score"))
    found = rerank.aligned(top.select("qid", "nth", "pos"), returned)
    w = Window.partitionBy("qid").orderBy(F.round(F.coalesce("rerank_score", F.lit(0.0)), 9).desc(), "nth")
    return found.select("qid", "pos", F.row_number().over(w).cast("long").alias("place"))


@_query
def target_rank(s, sf):
    return rerank.target_rank(_lexical(s, sf), _t(s, sf, "normativa").select("pos", "texto"), "texto", "encaje legal")


@_query
def hybrid_search(s, sf):
    """The whole search: hybrid, filtered, reranked, with what was actually done."""
    corpus = search.hashed_corpus(_t(s, sf, "normativa"), DIM)
    found = search.search(corpus, _asked(s, sf), "hybrid", 5, 0.7, {"tipo_norma": "Ley"}, rerank=True)
    return found.select("qid", "place", "pos", "score", "rerank_score", "modo", "alpha", "rerank", "doc_id")


# evaluation


@_query
def eval_silver_set(s, sf):
    return evaluate.silver_queries(_t(s, sf, "chunks_ner"), 200)


def _ranked(top: DataFrame, objects: DataFrame) -> DataFrame:
    return top.join(objects.select("pos", "doc_id"), "pos").select("qid", "doc_id", F.col("nth").alias("rank"))


def _strategies(s: SparkSession, sf: str) -> DataFrame:
    objects, relevant, (rows, asked, mean) = _t(s, sf, "normativa"), _relevant(s, sf), _both(s, sf, {"doc": "doc_id"})
    asked = fusion.with_tops(rows, asked, mean)
    ways = {"keyword": "word", "semantic": "cosine", "hybrid_0.5": 0.5, "hybrid_0.7": 0.7}
    places, best = evaluate.counted_places_and_best(rows, asked, list(ways.values()), relevant, (3, 30), mean)
    places = index.written(places, "places")
    found = [evaluate.measures(places.filter(F.col("kind") == i), relevant, 5).withColumn("estrategia", F.lit(name)) for i, name in enumerate(ways)]
    top = index.written(lexical.best(best, 30), "top")
    second = rerank.rerank(top.join(objects.select("pos", "doc_id", "texto"), "pos").join(_asked(s, sf), "qid"), "query", "texto", 30, most_chars=None)
    ranked = second.select("qid", "doc_id", F.col("place").alias("rank"))
    found.append(evaluate.metrics(ranked, relevant, 5).withColumn("estrategia", F.lit("hybrid_0.7_rerank")))
    return reduce(DataFrame.unionByName, found)


@_query
def eval_metrics(s, sf):
    relevant = _relevant(s, sf)
    ix = _index(s, sf)
    asked = lexical.asked_words(ix, _asked(s, sf), "qid", "query")
    places = evaluate.counted_places(_documents(s, sf, ix.documents), asked, ["word"], relevant, ix.mean_length)
    found = evaluate.measures(places, relevant, 5)
    return found.select("qid", *[F.round(c, 4).alias(c) for c in ("recall", "precision", "rr", "ndcg")])


@_query
def eval_metrics_cut_first(s, sf):
    found = evaluate.metrics(_ranked(_best_words(s, sf, 5), _t(s, sf, "normativa")), _relevant(s, sf), 5, cut_first=True)
    return found.select("qid", *[F.round(c, 4).alias(c) for c in ("recall", "precision", "rr", "ndcg")])


@_query
def eval_by_strategy(s, sf):
    return evaluate.summary(_strategies(s, sf), ["estrategia"])


@_query
def eval_models(s, sf):
    """The same measures for encoders of several sizes, by cosine alone."""
    objects, relevant, found = _t(s, sf, "normativa"), _relevant(s, sf), []
    for dim in (16, 32, 64):
        base, asked = _encoded(s, sf, dim)
        rows = base.join(objects.select("pos", F.col("doc_id").alias("doc")), "pos")
        found.append(evaluate.measures(evaluate.counted_places(rows, asked, ["cosine"], relevant), relevant, 5).withColumn("estrategia", F.lit(f"hash_{dim}")))
    return evaluate.summary(reduce(DataFrame.unionByName, found), ["estrategia"])


@_query
def eval_rerankers(s, sf):
    """The same measures for the first stage's order of 30 candidates, and for that of the second stage."""
    objects, relevant = _t(s, sf, "normativa"), _relevant(s, sf)
    top = index.written(_best_words(s, sf, 30).join(objects.select("pos", "doc_id", "texto"), "pos").join(_asked(s, sf), "qid"), "candidates")
    second = rerank.rerank(top, "query", "texto", 30).select("qid", "doc_id", F.col("place").alias("rank"))
    ways = [("none", top.select("qid", "doc_id", F.col("nth").alias("rank"))), ("overlap", second)]
    found = [evaluate.metrics(ranked, relevant, 5).withColumn("estrategia", F.lit(name)) for name, ranked in ways]
    return evaluate.summary(reduce(DataFrame.unionByName, found), ["estrategia"])


@_query
def eval_best(s, sf):
    return evaluate.best_strategy(evaluate.summary(_strategies(s, sf), ["estrategia"]), F.col("estrategia")).select("estrategia", "ndcg")


# answers


def _hits(s: SparkSession, sf: str) -> DataFrame:
    top = _best_words(s, sf, 5).withColumn("score", F.round("score", 4)).withColumnRenamed("nth", "n")
    return top.join(_t(s, sf, "normativa").select("pos", "titulo", "seccion", "tipo_norma", "materia", "fuente_url", "texto", "entidades"), "pos")


@_query
def citations(s, sf):
    c = answer.citations(_hits(s, sf))
    return c.select("qid", F.col("n").cast("long").alias("n"), "titulo", "seccion", "tipo_norma", "materia", "fuente_url", "fragmento", "score")


@_query
def context_block(s, sf):
    return answer.context(_hits(s, sf))


@_query
def extractive_answer(s, sf):
    return answer.extractive(_hits(s, sf), _asked(s, sf))


@_query
def history_window(s, sf):
    turns = _t(s, sf, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("turno"), F.when(F.col("event_type") == "view", "bot").otherwise(F.col("event_type")).alias("rol"), F.col("props").alias("contenido"))
    return answer.history_window(turns)


@_query
def query_log_latency(s, sf):
    t = _t(s, sf, "registro_consultas").distinct()
    ok = F.coalesce(F.lower(F.trim("modo")), F.lit("")).alias("modo")
    return t.filter("latencia_ms >= 0").groupBy(ok, F.to_date("ts").alias("dia")).agg(
        F.count(F.lit(1)).alias("consultas"), F.round(F.avg("latencia_ms"), 2).alias("media_ms"), F.round(F.max("latencia_ms"), 2).alias("max_ms"), F.sum("n_resultados").alias("resultados")
    )


@_query
def log_top_queries(s, sf):
    """How often every query of the log was asked, and how late its rows came in."""
    t = _t(s, sf, "registro_consultas").distinct()
    late = (F.unix_timestamp(F.col("recibido").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("d")
    return t.select(text.squash(F.lower("consulta")).alias("consulta"), late).groupBy("consulta").agg(F.count(F.lit(1)).alias("veces"), F.max("d").alias("mas_tarde_s"))
