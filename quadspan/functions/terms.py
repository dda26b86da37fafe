"""Scalar functions on terms (2.3): columns of a triple in, columns out; errors are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as v

c = F.col


def str_(o: str = "o") -> Column:
    return c(o)


def lang(ok: str = "ok", tag: str = "lang") -> Column:
    """'' for literals without one, null (an error) for nodes."""
    return F.when(c(ok) == 2, F.coalesce(c(tag), F.lit("")))


def datatype(ok: str = "ok", dt: str = "dt") -> Column:
    return F.when(c(ok) == 2, c(dt))


def is_iri(ok: str = "ok") -> Column:
    return c(ok) == 0


def is_blank(ok: str = "ok") -> Column:
    return c(ok) == 1


def is_literal(ok: str = "ok") -> Column:
    return c(ok) == 2


def encode_for_uri(x: Column) -> Column:
    """Percent-encodes all but unreserved characters."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def iri(x: Column) -> Column:
    """A term as a struct o, ok, dt, lang."""
    return term(x, 0)


def strdt(x: Column, dt: str) -> Column:
    return term(x, 2, F.lit(dt))


def strlang(x: Column, tag: str) -> Column:
    return term(x, 2, F.lit(v.RDF + "langString"), F.lit(tag))


def literal(x: Column) -> Column:
    return term(x, 2, F.lit(v.XSD + "string"))


def term(x: Column, kind: int, dt: Column | None = None, tag: Column | None = None) -> Column:
    """Null where x is: an unbound term."""
    null = F.lit(None).cast("string")
    made = F.struct(x.alias("o"), F.lit(kind).alias("ok"), (null if dt is None else dt).alias("dt"), (null if tag is None else tag).alias("lang"))
    return F.when(x.isNotNull(), made)


def shrink(x: Column, prefixes: dict[str, str]) -> Column:
    """The CURIE of an IRI column, by an expression made from the (bounded) prefix map."""
    out = x
    ranked = sorted(enumerate(prefixes.items()), key=lambda e: (len(e[1][1]), e[1][0] != "", -e[0]))
    for _, (prefix, ns) in ranked:
        out = F.when(x.startswith(ns) & (F.length(x) > len(ns)), F.concat(F.lit(prefix + ":"), F.substring(x, len(ns) + 1, 1 << 30))).otherwise(out)
    return out


def local_name(x: Column) -> Column:
    return F.regexp_replace(x, "^.*[#/]", "")


def humanise(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(local_name(x), "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))
