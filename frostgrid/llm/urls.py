"""Parts and canonical forms of URLs, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _authority(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")


def host_of(url: str | Column) -> Column:
    """The host in lower case, without port and final dot; null where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_replace(F.regexp_replace(F.lower(_authority(url)), r":[0-9]*$", ""), r"\.$", "")
    return F.when(host != "", host)


def _is_name(host: Column) -> Column:
    """Whether a host is a name with a dot, not an address of numbers."""
    return host.contains(".") & ~host.rlike(r"^[0-9.]+$|[:\[\]]")


def domain_of(host: str | Column) -> Column:
    """The last two labels of a host, null for addresses of numbers and names without a dot."""
    host = F.col(host) if isinstance(host, str) else host
    return F.when(_is_name(host), F.substring_index(host, ".", -2))


def suffix_of(host: str | Column) -> Column:
    """The last label of a host, null as in :func:`domain_of`."""
    host = F.col(host) if isinstance(host, str) else host
    return F.when(_is_name(host), F.substring_index(host, ".", -1))


def canonical_url(url: str | Column) -> Column:
    """Scheme and host in lower case, no user, default port or fragment, and ``/`` for an empty path."""
    url = F.col(url) if isinstance(url, str) else url
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    default = F.when(scheme == "http", r":80$").when(scheme == "https", r":443$").otherwise(r":$")
    authority = F.regexp_replace(F.lower(_authority(url)), default, "")
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), authority, path)).otherwise(url)


def host_suffixes(host: str) -> Column:
    """A host and every domain it lies in: ``a.b.c``, ``b.c`` and ``c``."""
    labels = F.split(F.col(host), r"\.")
    places = F.sequence(F.lit(1), F.size(labels))
    return F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
