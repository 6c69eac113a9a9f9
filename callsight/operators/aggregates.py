"""KPIs, label breakdowns and per-dimension rollups.

All aggregates are hash aggregates with map-side partial aggregation: the
group-by keys are low-cardinality labels or entities, so a hot key (one agent
holding a third of all calls) only grows one partial-aggregate entry per task,
never one task's input. ``F.mode`` keeps a small value->count map per group.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import CONNECTION_ORDER, OUTCOME_LABELS, TYPE_LABELS, UNKNOWN


def _col_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def mode_of(c: Column) -> Column:
    """Most frequent non-null value; ties -> smallest value."""
    return F.mode(c, deterministic=True)


def top_mode(c: Column) -> Column:
    """Mode ignoring 'Unknown' when anything else exists, else the plain mode."""
    return F.coalesce(mode_of(F.when(c != UNKNOWN, c)), mode_of(c))


def category_order(c: Column, order: Sequence[str]) -> Column:
    """Position in a fixed order (0-based), unknown labels -> 99."""
    expr = F.lit(99)
    for i, label in reversed(list(enumerate(order))):
        expr = F.when(c == label, F.lit(i)).otherwise(expr)
    return expr


def kpis(df: DataFrame, *, show_unknowns: bool = False) -> DataFrame:
    """A1: one row: total, connected, disconnected, pct_connected, top_type, top_outcome."""
    conn, typ, out = (_col_or_null(df, "Connected"), _col_or_null(df, "Type"),
                      _col_or_null(df, "Outcome"))
    if not show_unknowns:
        typ = F.when(typ != UNKNOWN, typ)
        out = F.when(out != UNKNOWN, out)
    c = F.count_if(conn == "Connected")
    d = F.count_if(conn == "Disconnected")
    return (df.agg(F.count(F.lit(1)).alias("total"), c.alias("connected"), d.alias("disconnected"),
                   mode_of(typ).alias("top_type"), mode_of(out).alias("top_outcome"))
              .withColumn("pct_connected", F.col("connected") * 100.0
                          / F.greatest(F.lit(1), F.col("connected") + F.col("disconnected")))
              .select("total", "connected", "disconnected", "pct_connected", "top_type", "top_outcome"))


def kpi_tiles(calls: DataFrame, excluded: DataFrame) -> DataFrame:
    """A2: KPIs with Unknown allowed as top value, plus the excluded count.

    Both inputs are scanned once in a single union + global aggregate (no join).
    """
    a = calls.select(_col_or_null(calls, "Connected").alias("Connected"),
                     _col_or_null(calls, "Type").alias("Type"),
                     _col_or_null(calls, "Outcome").alias("Outcome"), F.lit(False).alias("_ex"))
    b = excluded.select(F.lit(None).cast("string").alias("Connected"),
                        F.lit(None).cast("string").alias("Type"),
                        F.lit(None).cast("string").alias("Outcome"), F.lit(True).alias("_ex"))
    return flagged_tiles(a.unionByName(b).withColumn("included", ~F.col("_ex")))


def flagged_tiles(rows: DataFrame) -> DataFrame:
    """A2 over all calls of a batch with their labels and whether the gate let them in (``included``): one pass."""
    inc = F.col("included")
    c = F.count_if(inc & (F.col("Connected") == "Connected"))
    d = F.count_if(inc & (F.col("Connected") == "Disconnected"))
    return (rows.agg(F.count_if(inc).alias("total"), c.alias("connected"), d.alias("disconnected"),
                  mode_of(F.when(inc, F.col("Type"))).alias("top_type"),
                  mode_of(F.when(inc, F.col("Outcome"))).alias("top_outcome"),
                  F.count_if(~inc).alias("excluded"))
             .withColumn("pct_connected", F.col("connected") * 100.0
                         / F.greatest(F.lit(1), F.col("connected") + F.col("disconnected")))
             .select("total", "connected", "disconnected", "pct_connected", "top_type",
                     "top_outcome", "excluded"))


def _breakdown(df: DataFrame, col: str, order: Sequence[str], show_unknowns: bool) -> DataFrame:
    key = F.coalesce(_col_or_null(df, col), F.lit(UNKNOWN)).alias(col)
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    if not show_unknowns:
        out = out.filter(F.col(col) != UNKNOWN)
    return out.orderBy(category_order(F.col(col), order), F.col(col))


def connection_breakdown(df: DataFrame) -> DataFrame:
    """A3: counts per Connected value (null -> Unknown), fixed order."""
    return _breakdown(df, "Connected", CONNECTION_ORDER, True)


def type_breakdown(df: DataFrame, *, show_unknowns: bool = False) -> DataFrame:
    """A4."""
    return _breakdown(df, "Type", TYPE_LABELS, show_unknowns)


def outcome_breakdown(df: DataFrame, *, show_unknowns: bool = False) -> DataFrame:
    """A5."""
    return _breakdown(df, "Outcome", OUTCOME_LABELS, show_unknowns)


def by_dimension(df: DataFrame, key: str) -> DataFrame:
    """Per-key total, pct_connected, top_type, top_outcome; null key kept as a group;
    ordered by total desc then key (O7)."""
    if key not in df.columns:
        spark = df.sparkSession
        return spark.createDataFrame([], f"`{key}` string, total bigint, pct_connected double, "
                                         "top_type string, top_outcome string")
    conn = F.col("Connected")
    c = F.count_if(conn == "Connected")
    d = F.count_if(conn == "Disconnected")
    return (df.groupBy(key)
              .agg(F.count(F.lit(1)).alias("total"), c.alias("_c"), d.alias("_d"),
                   top_mode(F.col("Type")).alias("top_type"),
                   top_mode(F.col("Outcome")).alias("top_outcome"))
              .withColumn("pct_connected", F.col("_c") * 100.0 / F.greatest(F.lit(1), F.col("_c") + F.col("_d")))
              .select(key, "total", "pct_connected", "top_type", "top_outcome")
              .orderBy(F.col("total").desc(), F.col(key).asc_nulls_last()))


def by_agent(df: DataFrame) -> DataFrame:
    return by_dimension(df, "agent_id")


def by_campaign(df: DataFrame) -> DataFrame:
    return by_dimension(df, "campaign")


def breakdowns_one_pass(df: DataFrame, *, show_unknowns: bool = True) -> DataFrame:
    """The three chart count frames from one scan via GROUPING SETS.

    Returns (section, label, count, ord) with section in Connection/Types/Outcomes.
    """
    base = df.select(F.coalesce(_col_or_null(df, "Connected"), F.lit(UNKNOWN)).alias("c"),
                     F.coalesce(_col_or_null(df, "Type"), F.lit(UNKNOWN)).alias("t"),
                     F.coalesce(_col_or_null(df, "Outcome"), F.lit(UNKNOWN)).alias("o"))
    g = (base.groupingSets([["c"], ["t"], ["o"]], "c", "t", "o")
             .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid")))
    section = (F.when(F.col("_gid") == 3, F.lit("Connection"))
                .when(F.col("_gid") == 5, F.lit("Types")).otherwise(F.lit("Outcomes")))
    label = F.coalesce(F.col("c"), F.col("t"), F.col("o"))
    out = g.select(section.alias("section"), label.alias("label"), F.col("count"))
    if not show_unknowns:
        out = out.filter((F.col("section") == "Connection") | (F.col("label") != UNKNOWN))
    ordv = (F.when(F.col("section") == "Connection", category_order(F.col("label"), CONNECTION_ORDER))
             .when(F.col("section") == "Types", category_order(F.col("label"), TYPE_LABELS))
             .otherwise(category_order(F.col("label"), OUTCOME_LABELS)))
    return out.withColumn("ord", ordv)


SECTIONS = ("Connection", "Types", "Outcomes")


def summary_sections(df: DataFrame, context: Mapping[str, object], *,
                     show_unknowns: bool = False, ordered: bool = False) -> DataFrame:
    """Sectioned counts (+ spacer + context rows), count as string like the CSV.

    ``ordered`` sorts them as in the file: sections in turn, the most frequent labels first, then
    the spacer and the context rows as given."""
    spark = df.sparkSession
    places = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int")
    counts = breakdowns_one_pass(df, show_unknowns=show_unknowns).select(
        "section", "label", F.col("count").cast("string").alias("count"), places.alias("_place"), (-F.col("count")).alias("_rank"))
    extra = [("", "", "")] + [("Context", str(k), str(v)) for k, v in context.items()]
    ctx = spark.createDataFrame([(*row, len(SECTIONS) + 1, i) for i, row in enumerate(extra)],
                                "section string, label string, count string, _place int, _rank bigint")
    rows = counts.unionByName(ctx)
    if ordered:
        rows = rows.orderBy("_place", "_rank", "label")
    return rows.drop("_place", "_rank")


def entity_catalog(df: DataFrame) -> DataFrame:
    """Distinct non-blank (kind, value) for agents (id/name columns), campaigns, products."""
    sources = [(kind, c) for kind, cols in (("agent", ("agent_id", "agent_name", "agent")),
                                            ("campaign", ("campaign",)), ("product", ("product_name",)))
               for c in cols if c in df.columns]
    return _distinct_values(df, [(kind, tx.unicode_trim(F.col(c).cast("string"))) for kind, c in sources])


def _distinct_values(df: DataFrame, sources) -> DataFrame:
    """Distinct non-empty (kind, value) of several columns, in one pass over the rows."""
    if not sources:
        return df.sparkSession.createDataFrame([], "kind string, value string")
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), v.alias("value")) for kind, v in sources])
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def filter_options(df: DataFrame) -> DataFrame:
    """Sorted distinct non-empty agents and campaigns as (kind, value)."""
    sources = [(kind, F.col(c)) for kind, c in (("agent", "agent_id"), ("campaign", "campaign")) if c in df.columns]
    return _distinct_values(df, sources).orderBy("kind", "value")


def date_extent(df: DataFrame, tz: str = "Europe/Berlin") -> DataFrame:
    """Min / max local call date."""
    d = tx.local_date(F.col("start_time"), tz)
    return df.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"))


def batch_report(included: DataFrame, excluded: DataFrame) -> DataFrame:
    """Included, connected, disconnected, excluded counts (one union + aggregate)."""
    a = included.select(F.col("Connected"), F.lit(False).alias("_ex"))
    b = excluded.select(F.lit(None).cast("string").alias("Connected"), F.lit(True).alias("_ex"))
    return flagged_report(a.unionByName(b).withColumn("included", ~F.col("_ex")))


def flagged_report(rows: DataFrame) -> DataFrame:
    """A15 over all calls of a batch with their labels and whether the gate let them in (``included``): one pass."""
    inc = F.col("included")
    return rows.agg(F.count_if(inc).alias("included"),
                    F.count_if(inc & (F.col("Connected") == "Connected")).alias("connected"),
                    F.count_if(inc & (F.col("Connected") == "Disconnected")).alias("disconnected"),
                    F.count_if(~inc).alias("excluded"))


def scope_tallies(scope: DataFrame, key: str = "question_id", top: int = 3, *, size: str | None = None) -> DataFrame:
    """Per key and dimension (type / outcome): top labels as 'Label (n), ...' ordered by
    count desc then label, plus the scope size. A row is a call, or as many as its ``size`` column says. Tallies are partial-aggregated counts; the
    top-n per group is a WindowGroupLimit over at most #labels rows per group."""
    from pyspark.sql.window import Window
    labels = scope.groupBy(key, "Type", "Outcome").agg((F.sum(size) if size else F.count(F.lit(1))).alias("n"))
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).alias("label")) for d, c in (("type", "Type"), ("outcome", "Outcome"))])
    t = labels.select(key, "n", F.inline(dims)).groupBy(key, "dim", "label").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(key, "dim")
    ranked = (t.withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), F.col("label"))))
               .withColumn("scope_n", F.sum("n").over(w)).filter(F.col("r") <= int(top)))
    top3 = ranked.groupBy(key, "dim").agg(F.array_sort(F.collect_list(F.struct("r", "label", "n"))).alias("s"),
                                          F.first("scope_n").alias("scope_n"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["label"], F.lit(" ("), x["n"].cast("string"),
                                                            F.lit(")"))), ", ")
    return top3.select(key, "dim", text.alias("top3"), "scope_n")


# --- fixed values: texts of the answer sentence ---
ANSWER_TEXTS = {"shown": "Showing top {shown} of {total} calls.", "all": "{total} calls in scope.",
                "dates": "Date range: {from} → {to}.", "type": "Top types: {top}.", "outcome": "Top outcomes: {top}."}
# --- end fixed values ---


def answer_sentences(scope: DataFrame, specs: DataFrame, key: str = "question_id", *, shown: int | None = None,
                     order: str = "call_id", top: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """(key, answer): scope size, or how many of it are shown, the date range, and the most
    frequent types and outcomes of the shown rows; a spec without calls has its size 0 and dates.

    With ``sizes`` (key, n) the scope need hold the shown rows only. The scope is computed once and written; its sizes are partial counts, and the display limit is a window
    that Spark limits inside the tasks, so a question about everything sorts ``shown`` rows a task, not its scope."""
    from pyspark.sql.window import Window

    from ..session import staged
    from .questions import filled
    rows = staged(scope.select(key, "Type", "Outcome", F.col(order).alias("_order")), "answer-scope")
    if sizes is None:
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumnRenamed("n", "_total")
    if shown is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_order"))).filter(F.col("_n") <= int(shown))
    tallies = scope_tallies(rows.select(key, "Type", "Outcome"), key, top)
    per = tallies.groupBy(key).agg(F.first("scope_n").alias("_shown"),
                                   *[F.max(F.when(F.col("dim") == d, F.col("top3"))).alias(d) for d in ("type", "outcome")])
    per = sizes.join(per, key, "left")
    joined = specs.select(key, "date_from", "date_to").join(per, key, "left")
    total, n = F.coalesce("_total", F.lit(0)), F.coalesce("_shown", F.lit(0))
    values = {"shown": n.cast("string"), "total": total.cast("string"), "from": F.col("date_from").cast("string"),
              "to": F.col("date_to").cast("string")}
    text = F.concat_ws(" ", F.when(n < total, filled(ANSWER_TEXTS["shown"], values)).otherwise(filled(ANSWER_TEXTS["all"], values)),
                       filled(ANSWER_TEXTS["dates"], values),
                       *[filled(ANSWER_TEXTS[d], {"top": F.col(d)}) for d in ("type", "outcome")])
    return joined.select(key, text.alias("answer"))
