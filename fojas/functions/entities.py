"""Column functions that tag entities by rules, merge taggers and bring entities into canonical form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: rules by label in order, labels that only rules give, pairs that are always wrong ---
RULES = (
    ("moneda", r"bolívar(?:es)?|Bs\.?|USD|dólar(?:es)?|eur(?:os)?|yuan(?:es)?|rublo(?:s)?|lira(?:s)?|yen(?:es)?|velar(?:es)?"),
    ("sistema_de_pago", r"Cámara de Compensación(?: Electrónica)?|sistema de pagos|transferencias?|cheques?"),
    ("tipo_de_norma", r"ley|resolución|circular|convenio cambiario|providencia|aviso oficial|decreto|reglamento|acto administrativo"),
    ("institucion", r"Banco Central(?-i: de [A-ZÁÉÍÓÚ][a-záéíóúñ]+)?|Ministerio|Gaceta Oficial|Directorio"),
    ("indicador_economico", r"INPC|inflación|liquidez monetaria|base monetaria|encaje legal|tipo de cambio|tasa de interés|PIB|reservas internacionales"),
    ("instrumento_financiero", r"título(?:s)? de cobertura|bono(?:s)?|pagaré(?:s)?|letra(?:s)? del tesoro|acción(?:es)?"),
    ("materia_cambiaria", r"mesa de cambio|operador cambiario|casa de cambio|régimen cambiario|mercado cambiario"),
    ("periodo", r"[0-9]{4}|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"),
)
RULES_ONLY = ("tipo_de_norma", "periodo", "materia_cambiaria", "indicador_economico")
WRONG = ("sistema_de_pago:sistema de mercado cambiario", "sistema_de_pago:mecanismo de intervención cambiaria", "moneda:tipo de cambio")
# --- end of fixed values ---

#: Word characters of the rules' edges, spelled out so that every engine agrees on them.
_W = "0-9A-Za-z_áéíóúüñÁÉÍÓÚÜÑ"


def rule_entities(text: Column, rules: tuple = RULES) -> Column:
    """``label:value`` in lower case of every match, labels in the rules' order, each once; null gives an empty array."""
    t = F.coalesce(text, F.lit(""))

    def labelled(label: str, pattern: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(rf"(?iu)(?<![{_W}])({pattern})(?![{_W}])"), F.lit(1))
        return F.transform(found, lambda m: F.concat(F.lit(label + ":"), F.lower(F.trim(m))))

    return F.array_distinct(reduce(F.concat, [labelled(*r) for r in rules]))


def canonical(entities: Column) -> Column:
    """Entities with single spaces in their values, without empty or always wrong ones, each once, in order."""
    def one(e: Column) -> Column:
        label = F.substring_index(e, ":", 1)
        value = F.when(F.instr(e, ":") > 0, F.substring(e, F.instr(e, ":") + 1, F.length(e))).otherwise(F.lit(""))
        return F.concat(label, F.lit(":"), F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))

    fixed = F.transform(F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: e.isNotNull()), one)
    return F.array_distinct(F.filter(fixed, lambda e: ~e.endswith(":") & ~e.isin(*WRONG)))


def ensemble(rules: Column, model: Column) -> Column:
    """Rules alone for closed vocabularies, rules and model for the rest: closed first, then open rules, then the model's; a null model counts as none."""
    def closed(e: Column) -> Column:
        return F.substring_index(e, ":", 1).isin(*RULES_ONLY)

    none = F.array().cast("array<string>")
    rules, model = F.coalesce(rules, none), F.coalesce(model, none)
    return canonical(F.concat(F.filter(rules, closed), F.filter(rules, lambda e: ~closed(e)), F.filter(model, lambda e: ~closed(e))))
