"""Value standardisation: find renderings of the same value, propose one.

Everything after the first grouping works on a bounded vocabulary: a column
with more than ``MAX_DISTINCT`` values is no candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright import types as t
from tablewright.functions.identity import identity
from tablewright.operators import counts
from tablewright.operators.profile import text_columns

# The candidate gates.
MAX_DISTINCT = 200
IDENTIFIER_RATIO = 0.9


class UnknownRuleError(KeyError):
    """The rule does not exist or is not in the state the action needs."""


def small_text_columns(df: DataFrame) -> list[str]:
    """Text columns that could have at most ``MAX_DISTINCT`` values.

    A cheap estimate keeps wide-open text columns out of the exact grouping;
    four times the cap is far outside the estimate's error, and the exact cap
    is applied afterwards.
    """
    names = text_columns(df)
    if not names:
        return []
    row = df.agg(*[F.approx_count_distinct(t.column(n)).alias(f"d{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if row[f"d{i}"] <= 4 * MAX_DISTINCT]


def vocabulary(df: DataFrame) -> DataFrame:
    """(column_name, value, rows) of the candidate columns."""
    names = small_text_columns(df)
    if not names:
        empty = "column_name string, value string, rows bigint"
        return df.sparkSession.createDataFrame([], empty)
    vc = counts.count_values(df, names)
    sizes = vc.groupBy("column_name").agg(F.count("*").alias("d")).filter(
        F.col("d").between(2, MAX_DISTINCT)
    )
    return vc.join(F.broadcast(sizes), "column_name").select(  # one row per column
        "column_name", F.col("txt").alias("value"), F.col("n").alias("rows")
    )


def keyed_vocabulary(df: DataFrame) -> DataFrame:
    """The vocabulary with identity keys, identifier-like columns removed."""
    keyed = vocabulary(df).withColumn("id", identity("value")).select(
        "column_name", "value", "rows", "id.key", "id.is_clean", "id.is_title"
    )
    keyed = keyed.filter(F.col("key") != "")
    whole = Window.partitionBy("column_name")  # at most 200 rows each
    ratio = F.size(F.collect_set("key").over(whole)) / F.sum("rows").over(whole)
    return keyed.withColumn("ratio", ratio).filter(F.col("ratio") < IDENTIFIER_RATIO).drop("ratio")


def variant_groups(df: DataFrame) -> DataFrame:
    """Values sharing a key, with the rendering to standardise on.

    Most rows win; ties prefer tidy blanks, then title case, then the smallest.
    """
    keyed = keyed_vocabulary(df)
    best = Window.partitionBy("column_name", "key").orderBy(
        F.desc("rows"), F.desc("is_clean"), F.desc("is_title"), F.asc("value")
    )
    first = F.when(F.row_number().over(best) == 1, F.col("value"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("rows")).alias("neg"), "value")))
    groups = keyed.withColumn("best", first).groupBy("column_name", "key").agg(
        F.max("best").alias("canonical"),
        F.transform(ordered, lambda v: F.struct(v["value"].alias("value"), (-v["neg"]).alias("rows"))).alias("variants"),
        F.sum("rows").alias("group_rows"),
    )
    return groups.filter(F.size("variants") >= 2)


def mapping(groups: DataFrame) -> DataFrame:
    """(column_name, raw, canonical, rows) for the renderings that change."""
    each = groups.select("column_name", "canonical", F.explode("variants").alias("v"))
    return each.filter(F.col("v.value") != F.col("canonical")).select(
        "column_name", F.col("v.value").alias("raw"), "canonical", F.col("v.rows").alias("rows")
    )


def rules(groups: DataFrame) -> DataFrame:
    """One frozen rule per column: id, mapping and a sentence to judge it by."""
    part = F.format_string(
        '%d variants into "%s" (%d rows)', F.size("variants"), "canonical", "group_rows"
    )
    changed = F.transform(
        F.filter("variants", lambda v: v["value"] != F.col("canonical")),
        lambda v: F.struct(v["value"].alias("key"), F.col("canonical").alias("value")),
    )
    per_column = groups.withColumn("part", part).withColumn("changed", changed).groupBy("column_name").agg(
        F.sort_array(F.collect_list(F.struct("key", "part"))).alias("parts"),
        F.map_from_entries(F.flatten(F.collect_list("changed"))).alias("mapping"),
    )
    sentence = F.concat(
        F.lit('Standardize "'), "column_name", F.lit('": merge '),
        F.array_join(F.transform("parts", lambda p: p["part"]), ", "), F.lit("."),
    )
    return per_column.select(
        F.concat(F.lit("norm:"), "column_name").alias("rule_id"),
        "column_name", "mapping", sentence.alias("description"),
    )


def apply_mappings(df: DataFrame, mappings: dict[str, dict[str, str]]) -> DataFrame:
    """Exact-match replacement as a view; values outside the mapping pass through.

    A mapping holds at most ``MAX_DISTINCT`` entries, so it travels as a literal.
    """
    if not any(mappings.values()):
        return df
    out = []
    for name in df.columns:
        pairs = mappings.get(name)
        if not pairs:
            out.append(t.column(name))
            continue
        lookup = F.create_map(*[F.lit(x) for raw in sorted(pairs) for x in (raw, pairs[raw])])
        out.append(F.coalesce(lookup[t.column(name)], t.column(name)).alias(name))
    return df.select(*out)


def apply_mapping_table(df: DataFrame, name: str, mapped: DataFrame) -> DataFrame:
    """The same overlay with the mapping still a DataFrame (bounded as above)."""
    pairs = mapped.filter(F.col("column_name") == name).select(
        F.col("raw").alias("_raw"), F.col("canonical").alias("_canonical")
    )
    joined = df.join(F.broadcast(pairs), t.column(name) == F.col("_raw"), "left")
    return joined.select(
        *[
            F.coalesce("_canonical", t.column(c)).alias(c) if c == name else t.column(c)
            for c in df.columns
        ]
    )


class Standardisation:
    """Propose, approve, dismiss and revoke for one dataset.

    ``stored`` is the untouched data; ``view`` is what queries see.  With a ``journal`` (see the dataset store) earlier
    decisions are taken up and new ones kept: what was dismissed in one session is not proposed in the next.
    """

    def __init__(self, stored: DataFrame, journal=None):
        self.stored = stored
        self.journal = journal
        self.decisions: dict[str, dict] = journal.replay() if journal else {}

    def proposals(self) -> DataFrame:
        found = rules(variant_groups(self.stored if not self.decisions else self.view()))
        return found.filter(~F.col("column_name").isin(*self.decisions)) if self.decisions else found

    def _proposal(self, rule_id: str):
        row = self.proposals().filter(F.col("rule_id") == rule_id).first()
        if row is None:
            raise UnknownRuleError(rule_id)
        return row

    def _decide(self, column: str, status: str, mapping: dict[str, str] | None = None, description: str | None = None) -> None:
        if self.journal:
            self.journal.add(column, status, mapping, description)
        if status == "revoked":
            del self.decisions[column]
        else:
            self.decisions[column] = {"status": status, "mapping": mapping or {}, "description": description}

    def approve(self, rule_id: str) -> None:
        rule = self._proposal(rule_id)
        self._decide(rule["column_name"], "approved", dict(rule["mapping"]), rule["description"])

    def dismiss(self, rule_id: str) -> None:
        self._decide(self._proposal(rule_id)["column_name"], "dismissed")

    def revoke(self, rule_id: str) -> None:
        name = rule_id.removeprefix("norm:")
        if self.decisions.get(name, {}).get("status") != "approved":
            raise UnknownRuleError(rule_id)
        self._decide(name, "revoked")

    def approved(self) -> dict[str, dict[str, str]]:
        """What a dataset store keeps: column -> raw -> canonical."""
        return {c: d["mapping"] for c, d in self.decisions.items() if d["status"] == "approved"}

    def view(self) -> DataFrame:
        return apply_mappings(self.stored, self.approved())
