"""Robots rules: disallowed path prefixes per host."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from webloom.functions.urls import host_of


def disallowed_prefixes(text: str | None) -> list[str]:
    """Disallowed prefixes of the groups for every agent, different ones, longest first; Allow has no say."""
    prefixes: set[str] = set()
    everyone = False
    for line in (text or "").splitlines():
        key, colon, value = line.strip().partition(":")
        if not colon or line.strip().startswith("#"):
            continue
        key, value = key.strip().casefold(), value.strip()
        if key == "user-agent":
            everyone = value == "*"
        elif key == "disallow" and everyone and value:
            prefixes.add(value if value.startswith("/") else "/" + value)
    return sorted(prefixes, key=lambda p: (-len(p), p))


@F.pandas_udf(ArrayType(StringType()))
def _prefixes(text: pd.Series) -> pd.Series:
    return text.map(disallowed_prefixes)


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, prefix) from (host, status, body); a missing or failed file allows all."""
    usable = files.where("status < 400 and body is not null")
    return usable.select("host", F.explode(_prefixes("body")).alias("prefix"))


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The rows whose path begins with no disallowed prefix of their host; unparsable addresses are allowed.

    The join is on the host, so only the host's own rules are tested.
    """
    keyed = urls.withColumn("__host", host_of(F.col(url))).withColumn("__path", F.coalesce(F.nullif(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")), F.lit("/")))
    r = rules.select(F.col("host").alias("__rule_host"), "prefix")
    return keyed.join(r, (F.col("__host") == F.col("__rule_host")) & F.col("__path").startswith(F.col("prefix")), "left_anti").drop("__host", "__path")
