"""SQL that gives the rows of the core's queries, written for DuckDB and independent of the Spark expressions."""

from __future__ import annotations

from fojas.functions.entities import RULES, RULES_ONLY, WRONG
from fojas.functions.text import ACCENTED, KINDS, NO_KIND, NO_SUBJECT, PLAIN, STOP_WORDS, SUBJECTS

DIM = 32


def _toks(x: str, least: int = 2, stem: bool = True) -> str:
    found = f"regexp_extract_all(translate(lower(coalesce({x}, '')), '{ACCENTED}', '{PLAIN}'), '[a-z0-9]{{{least},}}')"
    return f"list_transform({found}, lambda t: left(t, 7))" if stem else found


def _rules(rules: tuple, other: str) -> str:
    blob = "lower(coalesce(fuente_url, '') || ' ' || coalesce(titulo, ''))"
    return "CASE " + " ".join(f"WHEN regexp_matches({blob}, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE '{other}' END"


_ASKED = "asked AS (SELECT DISTINCT md5(query) AS qid, query FROM eval_set WHERE query IS NOT NULL)"


def _bm25(asked: str = _ASKED, name: str = "lex") -> str:
    return f"""{asked},
toks AS (SELECT pos, {_toks("texto")} AS ts FROM normativa),
lens AS (SELECT pos, greatest(len(ts), 1) AS dl FROM toks),
size AS (SELECT count(*) AS n, sum(dl) / count(*) AS m FROM lens),
tf AS (SELECT pos, term, count(*) AS f FROM (SELECT pos, unnest(ts) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY ALL),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_toks("query")}) AS term FROM asked) GROUP BY ALL),
{name} AS (SELECT qid, tf.pos, sum(times * ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / m))) AS score
  FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN lens ON lens.pos = tf.pos CROSS JOIN size GROUP BY ALL)"""


def _codes(t: str) -> str:
    return f"list_reduce(list_transform(string_split({t}, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296)"


def _hash_counts(key: str, x: str, source: str, dim: int = DIM) -> str:
    return f"SELECT {key}, {_codes('t')} % {dim} AS b, count(*) AS w FROM (SELECT {key}, unnest({_toks(x, 3, False)}) AS t FROM {source}) GROUP BY ALL"


def _dense(dim: int, x: str = "") -> str:
    return f"""hd{x} AS ({_hash_counts("pos", "texto", "normativa", dim)}), hq{x} AS ({_hash_counts("qid", "query", "asked", dim)}),
nd{x} AS (SELECT pos, sqrt(sum(w * w)) AS s FROM hd{x} GROUP BY ALL), nq{x} AS (SELECT qid, sqrt(sum(w * w)) AS s FROM hq{x} GROUP BY ALL),
den{x} AS (SELECT qid, pos, dp / (q.s * d.s) AS score FROM (SELECT qid, pos, sum(h.w * a.w) AS dp FROM hd{x} h JOIN hq{x} a USING (b) GROUP BY ALL) JOIN nd{x} d USING (pos) JOIN nq{x} q USING (qid))"""


_DENSE = _dense(DIM)


def _linear(alpha: float, name: str = "fus") -> str:
    return f"""{name} AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.pos, b.pos) AS pos, {alpha} * coalesce(a.s, 0) + {round(1 - alpha, 9)} * coalesce(b.s, 0) AS score
  FROM (SELECT qid, pos, score / max(score) OVER (PARTITION BY qid) AS s FROM den) a
  FULL JOIN (SELECT qid, pos, score / max(score) OVER (PARTITION BY qid) AS s FROM lex) b ON a.qid = b.qid AND a.pos = b.pos)"""


def _rank(of: str, k: int, extra: str = "") -> str:
    return f"""(SELECT * FROM (SELECT qid, pos, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pos) AS nth FROM {of}
  WHERE score > 0{extra}) WHERE nth <= {k})"""


def _top(of: str, k: int = 10, extra: str = "", digits: int = 4) -> str:
    return f"SELECT qid, pos, nth, round(score, {digits}) AS score FROM {_rank(of, k, extra)}"


_PIECES = "pieces AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY 1) AS r FROM chunks_ner) WHERE r = 1)"
_SITE = r"nullif(regexp_extract(lower(trim(fuente_url)), '^(?:[a-z][a-z0-9+.\-]*://|//)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)', 1), '')"
_PATH = r"regexp_extract(fuente_url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)', 1)"
_USABLE = "len(vector) = 128 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AND len(list_filter(vector, lambda x: x IS NULL)) = 0"
_NORMAL = "array_to_string(list_filter(list_transform(string_split(texto, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t\\x{a0}]+', ' ', 'g'))), lambda l: l <> ''), chr(10))"
_DATE = r"regexp_extract(coalesce(texto, ''), '(?:^|[^0-9A-Za-z_])([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})(?:[^0-9A-Za-z_]|$)', 1)"
_WHEN = f"CAST(try_strptime(replace(nullif({_DATE}, ''), '-', '/'), '%-d/%-m/%Y') AS TIMESTAMP)"


def _canonical(e: str) -> str:
    one = "lambda x: CASE WHEN instr(x, ':') > 0 THEN split_part(x, ':', 1) || ':' || trim(regexp_replace(substring(x, instr(x, ':') + 1), '[\\s\\x{85}\\x{a0}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g')) ELSE x || ':' END"
    wrong = ", ".join(f"'{w}'" for w in WRONG)
    kept = f"list_filter(list_transform(list_filter(coalesce({e}, []::VARCHAR[]), lambda x: x IS NOT NULL), {one}), lambda x: NOT ends_with(x, ':') AND x NOT IN ({wrong}))"
    return f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)"


def _found_by_rules(text: str) -> str:
    """The rules' entities. Words are marked at both ends, since RE2 can't look around; a period that a word follows is marked as well."""
    marked = rf"regexp_replace(regexp_replace(coalesce({text}, ''), '([0-9A-Za-z_áéíóúüñÁÉÍÓÚÜÑ]+)', chr(1) || '\1' || chr(2), 'g'), '\.\x01', chr(3) || '.' || chr(1), 'g')"
    lists = []
    for label, pattern in RULES:
        ends = [p + r"\x02" if p != r"Bs\.?" else r"Bs\x02\.?" for p in pattern.replace(" ", r"\x02 \x01").split("|")]
        found = f"regexp_extract_all({marked}, '(?i)\\x01({'|'.join(ends)})', 1)"
        lists.append(f"list_transform({found}, lambda x: '{label}:' || lower(trim(replace(replace(x, chr(1), ''), chr(2), ''))))")
    return f"list_concat({', '.join(lists)})"


def _once(e: str) -> str:
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


#: Written forms whose tagging is measured: (label, form).
FORMS = [
    ("tipo_de_norma", "ley"), ("tipo_de_norma", "leyes"), ("tipo_de_norma", "resolución"), ("tipo_de_norma", "resoluciones"), ("tipo_de_norma", "circular"),
    ("tipo_de_norma", "circulares"), ("institucion", "ministerio"), ("institucion", "banco central"), ("moneda", "dólares"), ("instrumento_financiero", "bonos"),
    ("sistema_de_pago", "cheque"), ("sistema_de_pago", "transferencias"), ("indicador_economico", "encaje legal"), ("periodo", "enero"),
]
_CLOSED = "split_part(x, ':', 1) IN (" + ", ".join(f"'{x}'" for x in RULES_ONLY) + ")"


_ALL = 1_000_000_000


def _metrics(ranked: str, cut_first: bool = False, k: int = 5) -> str:
    cut = f" WHERE nth <= {k}" if cut_first else ""
    return f"""(WITH rel AS (SELECT DISTINCT md5(query) AS qid, doc_id_relevante AS doc_id FROM eval_set WHERE query IS NOT NULL),
  uniq AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY r, doc_id) AS rank FROM (SELECT qid, doc_id, min(nth) AS r FROM {ranked} JOIN normativa USING (pos){cut} GROUP BY ALL)),
  hits AS (SELECT * FROM uniq JOIN rel USING (qid, doc_id)),
  per AS (SELECT qid, count(*) FILTER (rank <= {k}) AS h, min(rank) AS f, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hits GROUP BY qid),
  sz AS (SELECT qid, count(DISTINCT doc_id) AS n FROM rel GROUP BY qid)
  SELECT qid, coalesce(h, 0) / n AS recall, coalesce(h, 0) / {k}.0 AS "precision", coalesce(1.0 / f, 0) AS rr,
    coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM sz LEFT JOIN per USING (qid))"""


_FOUR = 'round(recall, 4) AS recall, round("precision", 4) AS "precision", round(rr, 4) AS rr, round(ndcg, 4) AS ndcg'


def _strategies() -> str:
    parts = [
        f"SELECT *, '{name}' AS estrategia FROM {_metrics(_rank(of, _ALL))}"
        for name, of in (("keyword", "lex"), ("semantic", "den"), ("hybrid_0.5", "h5"), ("hybrid_0.7", "h7"))
    ]
    parts.append(f"SELECT *, 'hybrid_0.7_rerank' AS estrategia FROM {_metrics(_second('h7', 'texto'))}")
    return f"WITH {_bm25()}, {_DENSE}, {_linear(0.5, 'h5')}, {_linear(0.7, 'h7')}, m AS ({' UNION ALL '.join(parts)})"


def _second(of: str, text: str = "left(texto, 2000)") -> str:
    """The 30 best of a table in the order of the second stage."""
    return f"""(SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN k > 1 THEN s END DESC NULLS LAST, nth) AS nth FROM (
  SELECT r.qid, r.pos, nth, count(*) OVER (PARTITION BY r.qid) AS k,
    len(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '' AND contains(lower({text}), w)))::DOUBLE AS s
  FROM {_rank(of, 30)} r JOIN normativa USING (pos) JOIN asked ON asked.qid = r.qid))"""


_SUMMARY = 'SELECT estrategia, round(avg(recall), 4) AS recall, round(avg("precision"), 4) AS "precision", round(avg(rr), 4) AS rr, round(avg(ndcg), 4) AS ndcg, count(*) AS consultas FROM m GROUP BY estrategia'
_HITS = f"hits AS (SELECT qid, nth AS n, round(score, 4) AS score, normativa.* FROM {_rank('lex', 5)} JOIN normativa USING (pos))"
_LABEL = "coalesce(tipo_norma, 'Norma') || CASE WHEN coalesce(seccion, '') <> '' THEN ' — ' || seccion ELSE '' END"


def _dense_top(table: str, key: str, v: str, where: str) -> str:
    return f"""WITH u AS (SELECT {key} AS pos, list_transform({v}, lambda x: x::DOUBLE) AS v FROM {table} WHERE {where}),
n AS (SELECT pos, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
s AS (SELECT a.pos AS qid, b.pos, list_dot_product(a.v, b.v) AS score FROM n a JOIN n b ON a.pos % 20 = 0 AND a.pos <> b.pos)
{_top("s", 5)}"""


def _window_end(a: str) -> str:
    """End of the size window that starts at ``a``: the last space in its last two fifths, else its full length."""
    tail = f"reverse(substring(text, {a} + 1081, 720))"
    return f"CASE WHEN {a} + 1800 >= n THEN n WHEN instr({tail}, ' ') = 0 THEN {a} + 1800 ELSE {a} + 1800 - instr({tail}, ' ') END"


def oracle_sql() -> dict[str, str]:
    """SQL by the name of the query; operators that SQL can't express are missing and have tests of their own."""
    from fojas.operators import answer

    return {
        "norm_whitespace": f"SELECT DISTINCT doc_id, {_NORMAL} AS texto FROM extracted",
        "squeeze_blank_lines": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{0b}]+|[\s\x{0b}]+$', '', 'g')) AS h FROM documents",
        "sha_text": "SELECT DISTINCT doc_id, chunk_index, sha256(texto) AS h, sha256(texto) = doc_hash AS igual FROM chunks_ner",
        "tokenize": f"SELECT pos, array_to_string({_toks('texto')}, ' ') AS terminos FROM normativa",
        "first_date": f"SELECT DISTINCT doc_id, {_WHEN} AS fecha FROM extracted",
        "infer_type": f"SELECT DISTINCT doc_id, {_rules(KINDS, NO_KIND)} AS tipo FROM extracted",
        "infer_subject": f"SELECT DISTINCT doc_id, {_rules(SUBJECTS, NO_SUBJECT)} AS materia FROM extracted",
        "index_properties": f"""SELECT DISTINCT coalesce(doc_id, '') AS doc_id, left(coalesce(titulo, ''), 900) AS titulo, coalesce(texto, '') AS texto, coalesce(fuente_url, '') AS fuente_url,
coalesce(nullif(tipo_norma, ''), 'No especificado') AS tipo_norma, coalesce(nullif(materia, ''), 'General') AS materia, left(coalesce(seccion, ''), 300) AS seccion, coalesce(chunk_index, 0) AS chunk_index,
coalesce(doc_hash, '') AS doc_hash, coalesce(n_caracteres, 0) AS n_caracteres, 'desconocida' AS vigencia, {_WHEN} AS fecha_publicacion, CAST(coalesce(len(entidades), 0) AS INTEGER) AS n_entidades FROM chunks_ner""",
        "compact_corpus": """SELECT DISTINCT doc_id, coalesce(titulo, '') AS titulo, coalesce(seccion, '') AS seccion, coalesce(tipo_norma, 'Norma') AS tipo_norma, coalesce(materia, '') AS materia,
coalesce(fuente_url, '') AS fuente_url, trim(texto) AS texto FROM chunks_ner WHERE length(trim(texto)) >= 60""",
        "min_length": "SELECT DISTINCT doc_id, coalesce(length(texto), 0) >= 40 AS extraible, length(texto) > 200 AS evaluable, left(texto, 420) AS cita FROM extracted",
        "clean_secret": r"""SELECT DISTINCT consulta, trim(regexp_replace(regexp_replace(trim(' "`' || consulta || '''  '), '^["''`]+', ''), '["''`]+$', '')) AS limpia FROM registro_consultas""",
        "url_slug": rf"""SELECT DISTINCT fuente_url, left(regexp_replace(replace(coalesce(nullif(regexp_replace({_PATH}, '^/+|/+$', '', 'g'), ''), 'index'), '/', '_'), '[^a-zA-Z0-9._-]+', '_', 'g'), 120) AS nombre,
{_SITE} AS sitio, regexp_matches(lower({_PATH}), '\.(pdf|doc|docx|xls|xlsx|odt|ods)$') AS documento, starts_with({_PATH}, '/fondo/') OR starts_with({_PATH}, '/pagos/') AS seguida FROM extracted WHERE fuente_url IS NOT NULL""",
        "link_closure": f"""WITH RECURSIVE u AS (SELECT DISTINCT string_split(regexp_replace({_SITE} || {_PATH}, '/+$', ''), '/') AS p FROM extracted WHERE fuente_url IS NOT NULL AND {_SITE} IS NOT NULL),
step AS (SELECT p, unnest(range(1, len(p))) AS i FROM u),
links AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS desde, array_to_string(p[1:i + 1], '/') AS hasta FROM step),
reach AS (SELECT DISTINCT desde AS url, 0 AS nivel FROM links WHERE NOT contains(desde, '/') UNION SELECT hasta, nivel + 1 FROM reach JOIN links ON url = desde)
SELECT url, CAST(min(nivel) AS INTEGER) AS nivel FROM reach GROUP BY url""",
        "html_tree_text": f"SELECT DISTINCT doc_id, {_NORMAL} AS texto FROM extracted WHERE formato = 'html' AND texto IS NOT NULL",
        "link_extract": r"""WITH p AS (SELECT 'https://' || nullif(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*://|//)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)', 1), '') || '/' AS u, hash, id
FROM paginas WHERE estado = 'ok' AND url IS NOT NULL AND hash IS NOT NULL AND id IS NOT NULL)
SELECT DISTINCT u AS desde, u || hash AS hasta, false AS documento FROM p WHERE u IS NOT NULL UNION SELECT DISTINCT u, u || 'doc/' || id || '.pdf', true FROM p WHERE u IS NOT NULL""",
        "captures_latest": """SELECT id, (max(x)).fecha_captura AS fecha_captura, (max(x)).hash AS hash, count(*) AS capturas
FROM (SELECT id, {'fecha_captura': fecha_captura, 'hash': hash} AS x FROM (SELECT DISTINCT * FROM paginas WHERE estado = 'ok' AND id IS NOT NULL)) GROUP BY id""",
        "chunk_by_size": f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND text <> ''),
cut AS (SELECT doc_id, text, n, 0 AS a, {_window_end('0')} AS b FROM d
UNION ALL
SELECT doc_id, text, n, a2, {_window_end('a2')} FROM (SELECT doc_id, text, n, greatest(b - 200, a + 1) AS a2 FROM cut WHERE b < n))
SELECT doc_id, CAST(a AS INTEGER) AS inicio, CAST(b AS INTEGER) AS fin FROM cut""",
        "hierarchy_context": r"""WITH d AS (SELECT doc_id, min(texto) AS texto FROM extracted WHERE texto IS NOT NULL GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(texto, chr(10))) AS l, generate_subscripts(string_split(texto, chr(10)), 1) AS i FROM d),
m AS (SELECT *, nullif(regexp_extract(l, '^[ \t]*(?i:t[íi]tulo)[ \t]+([IVXLCDM]+|[0-9]+)[ \t]', 1), '') AS t, nullif(regexp_extract(l, '^[ \t]*(?i:cap[íi]tulo)[ \t]+([IVXLCDM]+|[0-9]+)[ \t]', 1), '') AS c,
  nullif(regexp_extract(l, '^[ \t]*(?i:secci[óo]n)[ \t]+([IVXLCDM]+|[0-9]+)[ \t]', 1), '') AS s FROM l),
w AS (SELECT doc_id, l, i, last_value(t IGNORE NULLS) OVER v AS titulo, last_value(c IGNORE NULLS) OVER v AS capitulo, last_value(s IGNORE NULLS) OVER v AS seccion FROM m
  WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, CAST(i AS INTEGER) AS linea_no, titulo, capitulo, seccion FROM w WHERE regexp_matches(l, '^[ \t]*(?i:art[íi]culo|art\.)[ \t]*[0-9]+')""",
        "entities_canonical": f"SELECT DISTINCT doc_id, chunk_index, array_to_string({_canonical('entidades')}, '|') AS entidades FROM chunks_ner",
        "entities_rules": f"WITH r AS (SELECT pos, {_found_by_rules('texto')} AS e FROM normativa) SELECT pos, array_to_string({_once('e')}, '|') AS entidades FROM r",
        "tagger_forms": f"""WITH {_PIECES}, r AS (SELECT lower(coalesce(texto, '')) AS t, coalesce(entidades, []::VARCHAR[]) AS d, {_found_by_rules('texto')} AS r FROM pieces),
f(etiqueta, forma) AS (VALUES {", ".join(map(str, FORMS))}), x AS (SELECT 'dadas' AS tagger, t, d AS e FROM r UNION ALL SELECT 'reglas', t, r FROM r),
y AS (SELECT tagger, etiqueta, forma, len(list_filter(e, lambda v: starts_with(lower(v), etiqueta || ':') AND contains(lower(v), left(split_part(forma, ' ', -1), 7)))) > 0 AS a,
  len(list_filter(e, lambda v: starts_with(lower(v), etiqueta || ':') AND contains(lower(v), forma))) > 0 AS b FROM x JOIN f ON contains(t, forma))
SELECT tagger, etiqueta, forma, count(*) AS n, count(*) FILTER (a) AS por_raiz, count(*) FILTER (b) AS literal FROM y GROUP BY GROUPING SETS ((tagger, etiqueta, forma), (tagger))""",
        "entities_ensemble": f"""WITH e AS (SELECT doc_id, chunk_index, coalesce(entidades, []::VARCHAR[]) AS m, {_found_by_rules('texto')} AS r FROM chunks_ner),
c AS (SELECT doc_id, chunk_index, list_concat(list_filter(r, lambda x: {_CLOSED}), list_filter(r, lambda x: NOT {_CLOSED}), list_filter(m, lambda x: NOT {_CLOSED})) AS a FROM e)
SELECT DISTINCT doc_id, chunk_index, array_to_string({_canonical('a')}, '|') AS entidades FROM c""",
        "entity_filter_any": "SELECT pos, doc_id FROM normativa WHERE tipo_norma = 'Ley' AND list_has_any(entidades, ['institucion:ministerio', 'periodo:enero'])",
        "date_range_filter": "SELECT pos, fecha_publicacion FROM normativa WHERE fecha_publicacion BETWEEN TIMESTAMP '2005-01-01' AND TIMESTAMP '2015-12-31'",
        "tagger_coverage": f"WITH {_PIECES} SELECT tipo_norma, count(*) AS filas, count(*) FILTER (len(entidades) > 0) AS con_entidad, round(count(*) FILTER (len(entidades) > 0) / count(*), 4) AS cobertura, round(avg(coalesce(len(entidades), 0)), 4) AS por_fila FROM pieces GROUP BY tipo_norma",
        "tagger_recall": f"""WITH {_PIECES}, s(tipo_norma, raiz) AS (VALUES ('Resolución', 'resoluc'), ('Circular', 'circular'), ('Convenio cambiario', 'convenio'), ('Decreto', 'decreto'), ('Ley', 'ley'), ('Aviso oficial', 'aviso')),
x AS (SELECT tipo_norma, contains(lower(texto), raiz) AS a, len([e for e in coalesce(entidades, []::VARCHAR[]) if starts_with(lower(e), 'tipo_de_norma:') AND contains(lower(e), raiz)]) > 0 AS b FROM pieces JOIN s USING (tipo_norma))
SELECT tipo_norma, count(*) FILTER (a) AS techo, count(*) FILTER (a AND b) AS detectadas, round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a), 0), 4) AS recall FROM x GROUP BY tipo_norma""",
        "tagger_oov_top": f"""WITH {_PIECES}, e AS (SELECT unnest({_canonical('entidades')}) AS e FROM pieces),
v AS (SELECT split_part(e, ':', 1) AS etiqueta, lower(substring(e, instr(e, ':') + 1)) AS valor, count(*) AS n FROM e GROUP BY ALL),
u AS (SELECT DISTINCT unnest({_found_by_rules('texto')}) AS e FROM pieces), k AS (SELECT split_part(e, ':', 1) AS etiqueta, lower(substring(e, instr(e, ':') + 1)) AS valor FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY etiqueta ORDER BY n DESC, valor) AS nth FROM v WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.etiqueta = v.etiqueta AND (contains(v.valor, k.valor) OR contains(k.valor, v.valor))))
SELECT etiqueta, valor, n FROM r WHERE nth <= 8""",
        "stratified_sample": f"WITH {_PIECES}, r AS (SELECT coalesce(tipo_norma, '') AS estrato, doc_id, chunk_index, row_number() OVER (PARTITION BY coalesce(tipo_norma, '') ORDER BY md5(concat_ws('|', doc_id, chunk_index))) AS n FROM pieces) SELECT estrato, doc_id, chunk_index FROM r WHERE n <= 15",
        "dedupe_hash": """WITH d AS (SELECT DISTINCT doc_id, formato, hash FROM extracted), k AS (SELECT *, CASE WHEN coalesce(formato = 'html', false) THEN NULL ELSE hash END AS h FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n FROM k) SELECT doc_id, formato, hash FROM r WHERE h IS NULL OR n = 1""",
        "incremental_pending": """WITH p AS (SELECT DISTINCT doc_id, chunk_index, doc_hash FROM chunks_ner),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY doc_id, chunk_index) AS n FROM p WHERE doc_hash IS NULL OR doc_hash NOT IN (SELECT doc_hash FROM normativa WHERE doc_hash IS NOT NULL))
SELECT doc_id, chunk_index, doc_hash FROM r WHERE n = 1 OR doc_hash IS NULL""",
        "align_vectors_by_text": """WITH k AS (SELECT trim(texto) AS t, arg_min(vector, pos) AS v FROM normativa WHERE vector IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT doc_id, chunk_index, texto FROM chunks_ner)
SELECT doc_id, chunk_index, round(v[1]::DOUBLE, 4) AS primero FROM p LEFT JOIN k ON trim(texto) = t""",
        "systematic_sample": """WITH r AS (SELECT doc_id, chunk_index, row_number() OVER (ORDER BY doc_id NULLS FIRST, chunk_index NULLS FIRST) - 1 AS n, count(*) OVER () AS k FROM (SELECT DISTINCT doc_id, chunk_index FROM chunks_ner))
SELECT doc_id, chunk_index FROM r WHERE n % CAST(ceil(k / 500.0) AS BIGINT) = 0""",
        "schema_rows": "SELECT column_name AS propiedad, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'VARCHAR[]' THEN 'array<string>' WHEN 'FLOAT[]' THEN 'array<float>' END AS tipo, CAST(row_number() OVER () - 1 AS INTEGER) AS orden FROM (DESCRIBE normativa)",
        "vector_checks": "SELECT count(vector) AS vectores, CAST(min(len(vector)) AS INTEGER) AS dim_min, CAST(max(len(vector)) AS INTEGER) AS dim_max, count(*) FILTER (vector IS NULL) AS sin_vector FROM normativa",
        "alignment_guard": f"SELECT count(*) AS objetos, count(*) FILTER ({_USABLE}) AS vectores, coalesce(bool_and(coalesce({_USABLE}, false)), true) AS alineados FROM normativa",
        "facet_catalog": "SELECT faceta, valor, count(*) AS n FROM (SELECT 'materia' AS faceta, materia AS valor FROM normativa UNION ALL SELECT 'tipo_norma', tipo_norma FROM normativa) WHERE valor <> '' GROUP BY ALL",
        "facets_documents": "SELECT faceta, valor, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS faceta, {c} AS valor FROM documents" for c in ("lang", "source", "materia", "tipo_norma")) + ") WHERE valor <> '' GROUP BY ALL",
        "stats": "SELECT count(*) AS objetos, count(DISTINCT doc_id) AS documentos, count(DISTINCT doc_hash) AS hashes, count(*) FILTER (len(entidades) > 0) AS con_entidad, count(fecha_publicacion) AS con_fecha, round(avg(length(texto)), 4) AS largo_medio FROM normativa",
        "chunk_counts": f"WITH {_PIECES} SELECT estrategia, formato, count(*) AS n, CAST(sum(length(texto)) AS BIGINT) AS caracteres FROM pieces GROUP BY ALL",
        "index_stats": f"SELECT count(*) AS n, round(sum(dl) / count(*), 4) AS mean_length FROM (SELECT greatest(len({_toks('texto')}), 1) AS dl FROM normativa)",
        "term_df": f"SELECT term, count(*) AS df, CAST(sum(f) AS BIGINT) AS f FROM (SELECT pos, term, count(*) AS f FROM (SELECT pos, unnest({_toks('texto')}) AS term FROM normativa) GROUP BY ALL) GROUP BY term",
        "doc_lengths": f"SELECT pos, CAST(greatest(len({_toks('texto')}), 1) AS INTEGER) AS dl FROM normativa",
        "bm25_topk": f"WITH {_bm25()} {_top('lex')}",
        "bm25_filtered": f"WITH {_bm25()} {_top('lex', 5, chr(32) + 'AND pos IN (SELECT pos FROM normativa WHERE tipo_norma = ' + repr('Ley') + ')')}",
        "bm25_log": f"WITH {_bm25('asked AS (SELECT DISTINCT md5(consulta) AS qid, consulta AS query FROM registro_consultas WHERE consulta IS NOT NULL)')} {_top('lex', 5)}",
        "l2_normalize": f"WITH n AS (SELECT pos, list_transform(vector, lambda x: x::DOUBLE) AS v FROM normativa WHERE {_USABLE}) SELECT pos, " + ", ".join(f"round(v[{i}] / sqrt(list_dot_product(v, v)), 5) AS v{i}" for i in (1, 64, 128)) + " FROM n",
        "dense_topk": _dense_top("normativa", "pos", "vector", _USABLE),
        "embeddings_topk": _dense_top("embeddings", "vec_id", "embedding", "true"),
        "hash_encode": f"SELECT pos, CAST(b AS INTEGER) AS cubo, w AS n FROM ({_hash_counts('pos', 'texto', 'normativa')})",
        "hybrid_linear": f"WITH {_bm25()}, {_DENSE}, {_linear(0.7)} {_top('fus')}",
        "hybrid_alpha0": f"WITH {_bm25()}, {_DENSE}, {_linear(0.0)} {_top('fus')}",
        "hybrid_alpha1": f"WITH {_bm25()}, {_DENSE}, {_linear(1.0)} {_top('fus')}",
        "hybrid_rrf": f"""WITH {_bm25()}, {_DENSE}, fus AS (SELECT qid, pos, sum(s) AS score FROM (
SELECT qid, pos, 0.5 / (60 + row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pos)) AS s FROM den WHERE score > 0 UNION ALL
SELECT qid, pos, 0.5 / (60 + row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pos)) AS s FROM lex WHERE score > 0) GROUP BY ALL) {_top('fus', digits=6)}""",
        "candidate_union": f"WITH {_bm25()}, {_DENSE} SELECT qid, pos FROM {_rank('lex', 20)} UNION SELECT qid, pos FROM {_rank('den', 20)}",
        "two_stage_search": f"""WITH {_bm25()}, c AS (SELECT r.qid, r.pos, nth, count(*) OVER (PARTITION BY r.qid) AS k,
len(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '' AND contains(lower(left(texto, 2000)), w)))::DOUBLE AS s FROM {_rank('lex', 30)} r JOIN normativa USING (pos) JOIN asked ON asked.qid = r.qid),
p AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN k > 1 THEN s END DESC NULLS LAST, nth) AS place, CASE WHEN k > 1 THEN s END AS rerank_score FROM c) SELECT * FROM p WHERE place <= 5""",
        "rerank_align_missing": f"""WITH {_bm25()}, c AS (SELECT * FROM {_rank('lex', 10)}), x AS (SELECT qid, pos, nth, CASE WHEN nth % 2 = 0 THEN score END AS s FROM c),
y AS (SELECT *, count(s) OVER (PARTITION BY qid) AS k FROM x)
SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(CASE WHEN k > 0 THEN coalesce(s, '-inf'::DOUBLE) END, 0), 9) DESC, nth) AS place FROM y""",
        "target_rank": f"WITH {_bm25()}, r AS (SELECT * FROM {_rank('lex', 1000000000)}) SELECT qid, min(nth) AS rank FROM r WHERE pos IN (SELECT pos FROM normativa WHERE contains(lower(texto), 'encaje legal')) GROUP BY qid",
        "hybrid_search": f"""WITH {_bm25()}, {_DENSE}, {_linear(0.7)}, c AS (SELECT r.*, query, normativa.doc_id, count(*) OVER (PARTITION BY r.qid) AS k,
len(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '' AND contains(lower(left(texto, 2000)), w)))::DOUBLE AS s
FROM {_rank('fus', 30, " AND pos IN (SELECT pos FROM normativa WHERE tipo_norma = 'Ley')")} r JOIN normativa USING (pos) JOIN asked ON asked.qid = r.qid),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN k > 1 THEN s END DESC NULLS LAST, nth) AS INTEGER) AS place FROM c)
SELECT qid, place, pos, round(score, 4) AS score, CASE WHEN k > 1 THEN s END AS rerank_score, 'hybrid' AS modo, 0.7::DOUBLE AS alpha, k > 1 AS rerank, doc_id FROM p WHERE place <= 5""",
        "eval_silver_set": f"""WITH p AS (SELECT *, md5(concat_ws('|', doc_id, chunk_index)) AS k, list_distinct(list_filter(regexp_extract_all(texto, '[A-Za-zÁÉÍÓÚáéíóúÑñ]{{4,}}'), lambda w: lower(w) NOT IN ({", ".join(repr(w) for w in STOP_WORDS)}))) AS w
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY 1) AS r FROM chunks_ner) WHERE r = 1) WHERE length(texto) > 200),
d AS (SELECT * FROM p WHERE len(w) > 0 ORDER BY k LIMIT 200),
q AS (SELECT *, trim(regexp_replace(replace(replace(coalesce(titulo, ''), '_', ' '), '.pdf', ''), '(^|[^0-9A-Za-z_])[0-9][0-9_.\\-]*', '\\1 ', 'g')) AS t, trim(coalesce(seccion, '')) AS s,
  array_to_string(list_transform(list_sort(list_transform(w, lambda x: md5(x) || x))[1:6], lambda x: x[33:]), ' ') AS m FROM d),
z AS (SELECT CASE WHEN s <> '' AND t <> '' THEN s || ' de ' || t || ': ' || m ELSE t || ': ' || m END AS query, doc_id AS doc_id_relevante, seccion AS seccion_origen, doc_hash AS chunk_hash, k FROM q)
SELECT query, doc_id_relevante, seccion_origen, chunk_hash FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY k) AS n FROM z) WHERE n = 1""",
        "eval_metrics": f"WITH {_bm25()} SELECT qid, {_FOUR} FROM {_metrics(_rank('lex', _ALL))}",
        "eval_metrics_cut_first": f"WITH {_bm25()} SELECT qid, {_FOUR} FROM {_metrics(_rank('lex', 50), True)}",
        "eval_by_strategy": f"{_strategies()} {_SUMMARY}",
        "eval_models": f"WITH {_ASKED}, {', '.join(_dense(d, str(d)) for d in (16, 32, 64))}, m AS ({' UNION ALL '.join(f'SELECT *, {chr(39)}hash_{d}{chr(39)} AS estrategia FROM {_metrics(_rank(f"den{d}", _ALL))}' for d in (16, 32, 64))}) {_SUMMARY}",
        "eval_rerankers": f"WITH {_bm25()}, m AS (SELECT *, 'none' AS estrategia FROM {_metrics(_rank('lex', 30))} UNION ALL SELECT *, 'overlap' AS estrategia FROM {_metrics(_second('lex'))}) {_SUMMARY}",
        "eval_best": f"{_strategies()} SELECT estrategia, ndcg FROM ({_SUMMARY}) ORDER BY ndcg DESC, estrategia LIMIT 1",
        "citations": f"WITH {_bm25()}, {_HITS} SELECT qid, n, titulo, seccion, tipo_norma, materia, fuente_url, left(coalesce(texto, ''), 600) AS fragmento, score FROM hits",
        "context_block": f"""WITH {_bm25()}, {_HITS} SELECT qid, string_agg('[' || n || '] ' || {_LABEL} || CASE WHEN coalesce(materia, '') <> '' THEN ' (materia: ' || materia || ')' ELSE '' END || chr(10) || trim(coalesce(texto, '')),
chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS contexto FROM hits GROUP BY qid""",
        "extractive_answer": f"""WITH {_bm25()}, {_HITS}, a AS (SELECT qid, string_agg('**[' || n || '] ' || {_LABEL} || ':** «' || left(replace(trim(coalesce(texto, '')), chr(10), ' '), 420) || '…»', chr(10) || chr(10) ORDER BY n) AS q FROM hits WHERE n <= 3 GROUP BY qid)
SELECT qid, CASE WHEN q IS NULL THEN '{answer.NOTHING}' ELSE '{answer.INTRO.strip()}' || chr(10) || chr(10) || chr(10) || q || chr(10) || chr(10) || chr(10) || chr(10) || '{answer.NOTE.strip()}' END AS respuesta FROM asked LEFT JOIN a USING (qid)""",
        "history_window": """WITH r AS (SELECT user_id AS conv, event_id AS turno, event_type AS t, trim(coalesce(props, '')) AS contenido, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
SELECT conv, turno, CASE WHEN t IN ('view', 'assistant', 'bot') THEN 'assistant' ELSE 'user' END AS rol, contenido FROM r WHERE n <= 6 AND contenido <> ''""",
        "query_log_latency": """SELECT coalesce(lower(trim(modo)), '') AS modo, CAST(ts AS DATE) AS dia, count(*) AS consultas, round(avg(latencia_ms), 2) AS media_ms, round(max(latencia_ms), 2) AS max_ms, CAST(sum(n_resultados) AS BIGINT) AS resultados
FROM (SELECT DISTINCT * FROM registro_consultas) WHERE latencia_ms >= 0 GROUP BY ALL""",
        "log_top_queries": r"""SELECT trim(regexp_replace(lower(consulta), '\s+', ' ', 'g')) AS consulta, count(*) AS veces, CAST(max(epoch(date_trunc('second', recibido)) - epoch(date_trunc('second', ts))) AS BIGINT) AS mas_tarde_s
FROM (SELECT DISTINCT * FROM registro_consultas) GROUP BY 1""",
    }
