"""Dashboards: guarded widget queries whose filters apply before aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright import types as t
from tablewright.plans.guard import QueryWorkspace, UnsafeQueryError

FILTER_MARKER = "/*FILTERS*/"  # fixed value: where filters go in a widget's WHERE


class InvalidWidgetError(ValueError):
    """A widget query without the marker cannot be filtered."""


@dataclass(frozen=True)
class Widget:
    widget_id: str
    sql: str
    source: str  # the dataset behind it
    title: str = ""


@dataclass(frozen=True)
class WidgetResult:
    answer: DataFrame | None
    error: str | None
    unaffected_by: tuple[str, ...]


Filters = Sequence[tuple[str, object]]


def filtered_sql(sql: str, filters: Filters) -> tuple[str, dict]:
    """The widget query with equality filters in its WHERE, and their values.

    Values travel as parameters, so none of them can change the query.
    """
    if FILTER_MARKER not in sql:
        raise InvalidWidgetError("A widget query must contain the /*FILTERS*/ marker in its WHERE clause.")
    clauses = "".join(f"({t.quoted(column)} = :widget_filter_{i}) AND " for i, (column, _) in enumerate(filters))
    text = sql.replace(FILTER_MARKER, clauses, 1).replace(FILTER_MARKER, "")
    return text, {f"widget_filter_{i}": str(v) for i, (_, v) in enumerate(filters)}


def cross_filter(filters: Filters, column: str, value: object) -> list[tuple[str, object]]:
    """Clicking a value replaces the filter on that column."""
    return [*((c, v) for c, v in filters if c != column), (column, value)]


def split_filters(df: DataFrame, filters: Filters) -> tuple[list[tuple[str, object]], tuple[str, ...]]:
    """The filters a source can take, and the columns it does not have."""
    fits = [(c, v) for c, v in filters if c in df.columns]
    return fits, tuple(c for c, _ in filters if c not in df.columns)


def run_widget(workspace: QueryWorkspace, widget: Widget, source: DataFrame | None, filters: Filters) -> WidgetResult:
    """One widget; whatever goes wrong stays inside it."""
    fits, unaffected = split_filters(source, filters) if source is not None else ([], tuple(c for c, _ in filters))
    try:
        sql, args = filtered_sql(widget.sql, fits)
        return WidgetResult(workspace.select(sql, args), None, unaffected)
    except (InvalidWidgetError, UnsafeQueryError, PySparkException) as bad:
        return WidgetResult(None, f"This widget's data is gone or invalid: {bad}", unaffected)


def run_dashboard(
    workspace: QueryWorkspace, widgets: Sequence[Widget], sources: dict[str, DataFrame], filters: Filters = ()
) -> dict[str, WidgetResult]:
    """Every widget under one set of filters."""
    return {w.widget_id: run_widget(workspace, w, sources.get(w.source), filters) for w in widgets}


def drill_down(source: DataFrame, filters: Filters) -> DataFrame:
    """The filtered source rows behind a widget."""
    fits, _ = split_filters(source, filters)
    kinds = {f.name: f.dataType for f in source.schema.fields}
    out = source
    for column, value in fits:
        out = out.filter(t.column(column) == F.lit(str(value)).cast(kinds[column]))
    return out

