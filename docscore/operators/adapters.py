"""Adapters of one's own, usable from SQL with a lateral join.

An adapter turns one response of an engine, a text, into regions. Registering it makes
a table function of the session: ``SELECT ... FROM responses, LATERAL name(response)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.operators import isolate

NAMES = ["page", "text", "polygon", "granularity", "confidence", "reading_order"]
ROW = f"{S.REGION}, error_label string, error_message string"


def _region(cells: dict[str, Any], place: int) -> tuple:
    """A region with what the adapter left out: page 0, no text, no polygon, a word, no confidence, the order of appearance."""
    unknown = set(cells) - set(NAMES)
    if unknown:
        raise ValueError(f"no such column of a region: {', '.join(sorted(unknown))}")
    made = {"page": 0, "text": "", "polygon": None, "granularity": "word", "confidence": None, "reading_order": place} | cells
    return tuple(made[n] for n in NAMES)


def table_function(parse: Callable[[str], Iterable[dict[str, Any]]]):
    """A table function of ``parse``: a row per region, or one row with an error if the response cannot be read.

    A null response has no regions. An exception whose message begins with ``BLOCKED:``
    is a blocked engine, any other a failure of recognition; regions made before it do
    not count.
    """

    class Regions:
        def eval(self, response: str):
            if response is None:
                return
            try:
                rows = [(*_region(cells, place), None, None) for place, cells in enumerate(parse(response))]
            except Exception as exc:
                error = isolate.error_of(exc, isolate.OCR_FAILURE, blockable=True)
                rows = [(*[None] * len(NAMES), error["label"], error["message"])]
            yield from rows

    return F.udtf(Regions, returnType=ROW)


def register(spark: SparkSession, name: str, parse: Callable[[str], Iterable[dict[str, Any]]]) -> None:
    """Make ``name(response)`` a table function of the session; a name that is registered again is replaced."""
    spark.udtf.register(name, table_function(parse))


def regions_by(spark: SparkSession, name: str, responses: DataFrame, response: str = "response") -> DataFrame:
    """The columns of ``responses`` with a row for each region that the registered adapter finds; rows without any go."""
    cells = ", ".join(f"`{c}`" for c in responses.columns if c != response)
    return spark.sql(f"SELECT {cells}, r.* FROM {{responses}} t, LATERAL {name}(t.`{response}`) r", responses=responses)
