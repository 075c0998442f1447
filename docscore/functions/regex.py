"""Regular expressions with Unicode classes, and offsets of all matches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\u001c-\u001f]"
ASCII_SPACE = r"[\t\n\f\r ]"  # what SQL engines call a blank
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def rx(pattern: str) -> str:
    """A Java pattern whose classes are Unicode-aware."""
    return "(?U)" + pattern


def replace(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, rx(pattern), by)


def strip(text: Column) -> Column:
    return strip_of(text, SPACE)


def strip_of(text: Column, space: str) -> Column:
    return replace(text, rf"^{space}+|{space}+\z")


def lines(text: Column) -> Column:
    return F.split(text, LINE_END, -1)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, stripped; null without a match or text in the group."""
    return F.nullif(strip(F.regexp_extract(text, rx(pattern), group)), F.lit(""))


def all_groups(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern)), group)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it is used inside lambdas, which compute all else anew for each element."""
    return F.transform(F.array(value), body)[0]


_CHUNK = 64


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _added(values: str, start: str) -> str:
    """``start`` plus the sum of all values before, for every value."""
    zero = f"named_struct('at', {start}, 'out', CAST(array() AS array<int>))"
    return f"aggregate({values}, {zero}, (acc, v) -> named_struct('at', acc.at + v, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"


def running(values: str, levels: int = 2) -> str:
    """SQL for the sum of those before it, for every int of an array (also SQL).

    An array grows by copying, so sums are made in chunks, from the sums of the chunks,
    and these likewise: the cost stays near the size of the array.
    """
    if not levels:
        return _added(values, "0")
    all_, chunks = f"n{levels}", f"c{levels}"
    cut = f"transform(sequence(0, CAST(floor((size({all_}) - 1) / {_CHUNK}) AS INT)), k -> slice({all_}, k * {_CHUNK} + 1, {_CHUNK}))"
    sums = running(f"transform({chunks}, c -> aggregate(c, 0, (a, v) -> a + v))", levels - 1)
    whole = _sql_let(chunks, cut, f"flatten(zip_with({chunks}, {sums}, (c, s) -> {_added('c', 's')}))")
    return _sql_let(all_, values, f"if(size({all_}) > 0, {whole}, CAST(array() AS array<int>))")


def matches(column: str, pattern: str, group: int = 0) -> Column:
    """``array<struct<pos, value>>`` of all matches in a column in order; the pattern never matches the empty string.

    Offsets are running sums over the pieces between the matches and the matches
    themselves. Null text gives null. Written as SQL text, which Spark parses at once:
    hundreds of calls for one expression take longer than many a query.
    """
    text, rule = f"`{column}`", _sql_text(rx(pattern))
    value = "w" if group == 0 else f"regexp_extract_all({text}, {rule}, {group})"
    lengths = "zip_with(p, w, (a, b) -> length(a) + length(b))"
    starts = f"zip_with({running(lengths)}, p, (at, a) -> at + length(a))"
    placed = f"zip_with({starts}, {value}, (pos, value) -> named_struct('pos', pos, 'value', value))"
    pieces = _sql_let("p", f"slice(split({text}, {rule}, -1), 1, size(w))", placed)
    return F.expr(f"if({text} IS NULL, NULL, {_sql_let('w', f'regexp_extract_all({text}, {rule}, 0)', pieces)})")


def positions(column: str, pattern: str) -> Column:
    return F.transform(matches(column, pattern), lambda m: m["pos"])


def nearest(positions: Column, target: Column) -> Column:
    """Distance to the nearest position; 1e9 if there is none."""
    return F.coalesce(F.array_min(F.transform(positions, lambda p: F.abs(p - target))), F.lit(1_000_000_000))


def places(text: Column, patterns: dict[str, tuple[str, int | None]]) -> Column:
    """All matches of many patterns in short texts, a struct with an array for each pattern.

    Patterns are Python's, with the group that is wanted, which begins where the match does: ``array<struct<pos, value>>``, or
    ``array<int>`` of offsets where the group is none. ``matches`` goes through a text twice and adds
    up lengths by lambdas; for a dozen patterns that takes some ten times as long. Null text has no matches.
    """
    kinds = {name: "array<int>" if group is None else "array<struct<pos int, value string>>" for name, (_, group) in patterns.items()}
    rules = [(re.compile(pattern), group) for pattern, group in patterns.values()]

    @F.arrow_udf("struct<" + ", ".join(f"{name} {kind}" for name, kind in kinds.items()) + ">")
    def found(texts: pa.Array) -> pa.Array:
        rows, columns = [t or "" for t in texts.to_pylist()], []
        for rule, group in rules:
            ends, at, values = [0], [], []
            for row in rows:
                for m in rule.finditer(row):
                    at.append(m.start())
                    if group is not None:
                        values.append(m[group])
                ends.append(len(at))
            each = pa.array(at, pa.int32())
            if group is not None:
                each = pa.StructArray.from_arrays([each, pa.array(values, pa.string())], names=["pos", "value"])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each))
        return pa.StructArray.from_arrays(columns, names=list(kinds))

    return found(text)
