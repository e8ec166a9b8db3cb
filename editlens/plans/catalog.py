"""All registered queries by name: the operator's identifier and what it does."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from editlens.plans import evaluation_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]
NAMED = re.compile(r"[a-z]\d\d_")


def registered(module: ModuleType) -> dict[str, Query]:
    return {name: fn for name, fn in inspect.getmembers(module, inspect.isfunction) if NAMED.match(name)}


QUERIES: dict[str, Query] = {**registered(evaluation_queries), **registered(table_queries)}
