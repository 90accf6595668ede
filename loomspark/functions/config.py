"""TOML and YAML of site settings and front matter as JSON strings, for from_json and parse_json."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

try:
    import yaml
except ImportError:  # front matter then stays unparsed
    yaml = None


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


@F.pandas_udf(StringType())
def toml_to_json(texts: pd.Series) -> pd.Series:
    """Null for null and for what isn't TOML."""
    def one(t: str | None) -> str | None:
        try:
            return _json(tomllib.loads(t)) if t is not None else None
        except tomllib.TOMLDecodeError:
            return None

    return texts.map(one)


@F.pandas_udf(StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """Null for null, for what isn't YAML, and where no YAML library is installed."""
    def one(t: str | None) -> str | None:
        if t is None or yaml is None:
            return None
        try:
            return _json(yaml.safe_load(t) or {})
        except yaml.YAMLError:
            return None

    return texts.map(one)
