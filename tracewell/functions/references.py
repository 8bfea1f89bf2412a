"""References in a text: addresses, repositories and file paths, each once for a text, as an array of (kind, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an address may hold, and the endings of files that a bare name must have.
URL = "https?://[^\\s<>\"')\\]},;]+"
ENDINGS = "ts js tsx jsx mjs cjs py rb go rs java kt cs cpp c h json yaml yml toml xml csv md txt html css scss sh bash zsh ps1 bat cmd dockerfile env gitignore eslintrc config lock log".split()
PATH = f"(?<![\\w./:-])(?:\\.{{1,2}}/[\\w./-]+|/\\w[\\w./-]*|[A-Z]:\\\\[\\w.\\\\/-]+|\\w[\\w./-]*\\.(?:{'|'.join(ENDINGS)})(?![\\w/-]))"
REPOSITORY = "github\\.com/([\\w.-]+/[\\w.-]+)"


def urls(text: Column) -> Column:
    """Distinct addresses without the punctuation that ends a sentence."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.)>,;:!?]+\\z", "")))


def paths(text: Column) -> Column:
    """Distinct file paths outside addresses."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), URL, " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(PATH), F.lit(0)), lambda p: F.regexp_replace(p, "\\.+\\z", "")))


def repositories(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REPOSITORY), F.lit(1))
    return F.array_distinct(F.transform(found, lambda r: F.regexp_replace(r, "\\.+\\z", "")))


def references(df: DataFrame, item: str, text: str = "text") -> DataFrame:
    """(item, kind, value), one row a reference."""
    kinds = {"url": urls, "path": paths, "repository": repositories}
    arrays = [_tagged(k, f(F.col(text))) for k, f in kinds.items()]
    return df.select(item, F.explode(F.concat(*arrays)).alias("r")).select(item, "r.kind", "r.value")


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def unknown(found: DataFrame, known: DataFrame) -> DataFrame:
    """References that a listing of (kind, value) does not have: an anti-join, so the listing may be of any size."""
    return found.join(known.select("kind", "value"), ["kind", "value"], "left_anti")
