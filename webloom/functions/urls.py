"""Canonical URLs and their parts."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The tracking parameters that are dropped, in any letter case.
TRACKING = frozenset({"utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"})
_DEFAULT_PORT = {"http": 80, "https": 443}
_PATH_SAFE = "/@:!$'()*,+&=;-._~"
_QUERY_SAFE = "?/:@!$'()*,-._~"
_HAS_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for part in parts[1:]:
        if part == "..":
            if out:
                out.pop()
        elif part != ".":
            out.append(part)
    if parts[-1] in (".", ".."):
        out.append("")
    return "/" + "/".join(out)


def _ascii_host(host: str) -> str:
    host = host.lower()
    return host if host.isascii() else host.encode("idna").decode("ascii")


def canonical_url(url: str, base: str | None = None) -> str:
    """The canonical http(s) form of a URL; ``ValueError`` if it has none.

    Relative and scheme-relative addresses are joined to ``base`` as it is
    given. Scheme and host become lower case; fragment, default port, tracking
    parameters and a trailing slash (except the root's) go; the remaining
    parameters are sorted by name and value.
    """
    raw = url.strip()
    if not raw:
        raise ValueError("the URL is empty")
    if raw.startswith("//") or not _HAS_SCHEME.match(raw):
        if base is None or not base.strip():
            raise ValueError("a relative URL needs a base")
        stem = urlsplit(base.strip())
        if stem.scheme.lower() not in _DEFAULT_PORT:
            raise ValueError("the base must be an http or https URL")
        if not stem.hostname:
            raise ValueError("the base has no host")
        raw = urljoin(base.strip(), raw)
    parts = urlsplit(raw)
    scheme = parts.scheme.lower()
    if scheme not in _DEFAULT_PORT:
        raise ValueError("only http and https URLs have a canonical form")
    if not parts.hostname:
        raise ValueError("the URL has no host")
    host = _ascii_host(parts.hostname)
    if ":" in host:
        host = f"[{host}]"
    user = parts.username and quote(unquote(parts.username), safe="!$'()*,-._~")
    if user and parts.password is not None:
        user += ":" + quote(unquote(parts.password), safe="!$'()*,-._~")
    port = parts.port
    netloc = (f"{user}@" if user else "") + host + ("" if port is None or port == _DEFAULT_PORT[scheme] else f":{port}")
    path = unquote(parts.path)
    path = (_without_dots(path) if "." in path else path).rstrip("/") or "/"
    pairs = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.casefold() not in TRACKING)
    part = lambda s: quote(s, safe=_QUERY_SAFE + " ").replace(" ", "+")
    query = "&".join(f"{part(k)}={part(v)}" for k, v in pairs)
    return f"{scheme}://{netloc}{quote(path, safe=_PATH_SAFE)}" + (f"?{query}" if query else "")


def _or_none(url: str | None, base: str | None = None) -> str | None:
    if url is None:
        return None
    try:
        return canonical_url(url, base)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _canonical(url: pd.Series) -> pd.Series:
    return url.map(_or_none)


@F.pandas_udf(StringType())
def _canonical_on(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([_or_none(u, b) for u, b in zip(url, base)], index=url.index, dtype=object)


#: Addresses that are canonical as they stand; they need no Python.
PLAIN = r"^https?://[a-z0-9][a-z0-9.-]*(/[A-Za-z0-9_~-]+)*$"


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Canonical form of a URL column; null where there is none (null, blank, relative without a base, other schemes, no host)."""
    if base is not None:
        return _canonical_on(url, base)
    # the path alternative needs at least one segment: a bare host gets a slash
    plain = url.rlike(PLAIN) & url.rlike(r"^https?://[^/]+/")
    return F.when(plain, url).otherwise(_canonical(F.when(~plain, url)))


def host_of(url: Column) -> Column:
    """Lower-case host without port; null if the URL cannot be parsed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def failure_host(url: Column) -> Column:
    """Lower-case authority of an http(s) URL, with port and user info; '' if it is no such URL."""
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1))


def parent_url(url: Column) -> Column:
    """The canonical URL one path segment up, without query and user info; null for a root or another scheme."""
    scheme = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1))
    authority = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#]+)", 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(F.regexp_replace(authority, ":443$", ""))
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    up = F.concat(scheme, F.lit("://"), authority, F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    return F.when((scheme != "") & (authority != "") & (F.size(parts) > 0), up)
