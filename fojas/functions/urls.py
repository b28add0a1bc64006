"""Column functions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^(?:[a-z][a-z0-9+.\-]*://|//)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)"


def site_of(url: Column) -> Column:
    """Host in lower case without user, port and a leading ``www.``; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(url)), _HOST, 1), F.lit(""))


# --- fixed values: endings of documents, links that lead nowhere ---
DOCUMENT_ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".odt", ".ods")
NO_LINKS = r"^(#|mailto:|javascript:|tel:)"
# --- end of fixed values ---


def path_of(url: Column) -> Column:
    """The path of a URL, without query and fragment; empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def slug(url: Column, most: int = 120) -> Column:
    """A file name from a URL's path: ``/`` and other runs become ``_``; ``index`` for an empty path."""
    bare = F.coalesce(F.nullif(F.regexp_replace(path_of(url), "^/+|/+$", ""), F.lit("")), F.lit("index"))
    return F.substring(F.regexp_replace(F.replace(bare, F.lit("/"), F.lit("_")), "[^a-zA-Z0-9._-]+", "_"), 1, most)


def is_document(url: Column) -> Column:
    """Whether the path ends like a document to download."""
    return F.lower(path_of(url)).rlike(r"\.(pdf|doc|docx|xls|xlsx|odt|ods)$")


def followed(url: Column, prefixes: list[str]) -> Column:
    """Whether the path starts with one of the prefixes."""
    found = F.lit(False)
    for p in prefixes:
        found = found | path_of(url).startswith(p)
    return found
