"""Column functions over text: tokens, white space, dates, kinds of norm, limits.

All are built-in expressions; null gives null unless stated otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accents that the tokenizer folds, term length, rules for kind and subject, default labels ---
ACCENTED = "áàâäãåāăąéèêëēĕėęěíìîïĩīĭįóòôöõōŏőúùûüũūŭůűųñńņňçćĉċčýÿŷśŝşšžźżğģķļľłŕŗřţťďĵĥ"
PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiiioooooooouuuuuuuuuunnnncccccyyysssszzzggklllrrrttdjh"
STEM = 7
KINDS = (
    ("ley", "Ley"), ("convenio", "Convenio cambiario"), ("resoluci", "Resolución"), ("circular", "Circular"), ("aviso", "Aviso oficial"),
    ("providencia", "Providencia"), ("decreto", "Decreto"), ("acto", "Acto administrativo"), ("reglamento", "Reglamento"),
)
NO_KIND = "Documento normativo"
SUBJECTS = (
    ("cambiar", "Cambiario"), ("monetar", "Monetario"), ("pago", "Sistema de pagos"), ("mineral", "Minerales estratégicos"),
    ("inpc|precio", "Precios e inflación"), ("encaje", "Encaje legal"), ("titulo", "Títulos de cobertura"),
)
NO_SUBJECT = "General"
STOP_WORDS = (
    "para como según sobre entre desde hasta cuando toda todos mismo misma serán deberá podrá artículo único"
).split()
# --- end of fixed values ---

_SPACE = "[ \\t\\u00a0]+"


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column, stem: int = STEM, least: int = 2) -> Column:
    """Runs of at least ``least`` letters a-z and digits after :func:`fold`, each cut to ``stem`` characters; null gives an empty array."""
    pattern = f"([a-z0-9]{{{least},{stem}}})[a-z0-9]*" if stem else f"([a-z0-9]{{{least},}})"
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(1))


def normalize_lines(text: Column) -> Column:
    """Each line with single spaces and none at its ends; blank lines dropped."""
    lines = F.transform(F.split(text, "\n", -1), lambda l: F.trim(F.regexp_replace(l, _SPACE, " ")))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def squeeze_blank_lines(text: Column) -> Column:
    """Three and more line ends become two; no white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """Every run of white space is one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sha256(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as hexadecimal digits."""
    return F.sha2(text, 256)


def first_date(text: Column) -> Column:
    """The first d/m/yyyy or d-m-yyyy of a text as a timestamp; null without one and where it is no date (later ones don't count)."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:^|[^0-9A-Za-z_])([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})(?![0-9A-Za-z_])", 1)
    return F.try_to_timestamp(F.replace(F.nullif(first, F.lit("")), F.lit("-"), F.lit("/")), F.lit("d/M/yyyy")).cast("timestamp_ntz")


def _first_rule(blob: Column, rules: tuple, other: str) -> Column:
    return reduce(lambda rest, r: F.when(blob.rlike(r[0]), F.lit(r[1])).otherwise(rest), reversed(rules), F.lit(other))


def infer_kind(url: Column, title: Column) -> Column:
    """The kind of norm, by the first rule found in address and title; never null."""
    return _first_rule(F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")))), KINDS, NO_KIND)


def infer_subject(url: Column, title: Column) -> Column:
    """The subject, by the first rule found in address and title; never null."""
    return _first_rule(F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")))), SUBJECTS, NO_SUBJECT)


def clean_secret(value: Column) -> Column:
    """A value without white space and wrapping quotation marks at its ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(value), "^[\"'`]+", ""), "[\"'`]+$", ""))


def content_words(text: Column) -> Column:
    """Runs of four and more letters that are no stop words, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-zÁÉÍÓÚáéíóúÑñ]{4,})"), F.lit(1))
    return F.filter(found, lambda w: ~F.lower(w).isin(STOP_WORDS))


def title_for_query(title: Column) -> Column:
    """A title without underscores, ``.pdf`` and numbers."""
    bare = F.replace(F.replace(F.coalesce(title, F.lit("")), F.lit("_"), F.lit(" ")), F.lit(".pdf"), F.lit(""))
    return F.trim(F.regexp_replace(bare, r"(^|[^0-9A-Za-z_])[0-9][0-9_.\-]*", "$1 "))


def index_properties() -> dict[str, Column]:
    """The properties of an indexed object from a chunk's columns, with defaults for what is missing or empty."""
    def text(c: str, other: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)).alias(c)

    return {
        "doc_id": text("doc_id", ""), "titulo": F.substring(F.coalesce("titulo", F.lit("")), 1, 900), "texto": text("texto", ""), "fuente_url": text("fuente_url", ""),
        "tipo_norma": text("tipo_norma", "No especificado"), "materia": text("materia", "General"),
        "entidades": F.coalesce("entidades", F.array().cast("array<string>")), "seccion": F.substring(F.coalesce("seccion", F.lit("")), 1, 300),
        "chunk_index": F.coalesce("chunk_index", F.lit(0)), "doc_hash": text("doc_hash", ""), "n_caracteres": F.coalesce("n_caracteres", F.lit(0)),
        "vigencia": F.lit("desconocida"), "fecha_publicacion": first_date(F.col("texto")),
    }
