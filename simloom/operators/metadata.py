"""Node metadata: merging sheets, table views, groups and colour scales."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions.headers import stripped

NUMBER_WORDS = {"number", "num", "numerical"}
PROTECTED = {"node id"}


def sheet_columns(names: list, types: list) -> list[tuple[int, str, str]]:
    """``(position, name, type)`` of a sheet whose first two rows are names and types."""
    columns = []
    for k, name in enumerate(names[1:], start=1):
        name = (name or "").strip()
        if not name:
            continue
        if not re.fullmatch(r"[a-zA-Z0-9_\-.]+", name):
            raise ValueError(f"property name {name!r} has illegal characters")
        word = (types[k] or "").strip().lower() if k < len(types) else ""
        columns.append((k, name, "number" if word in NUMBER_WORDS else "text"))
    if not columns:
        raise ValueError("no property names in the first row")
    return columns


def latest_rows(sheet: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in sheet order. Grouping collapses repeats before the shuffle."""
    rest = [c for c in sheet.columns if c not in (key, order)]
    return (
        sheet.groupBy(key)
        .agg(F.max_by(F.struct(*rest), order).alias("last"))
        .select(key, *[F.col("last")[c].alias(c) for c in rest])
    )


def merged_metadata(nodes: DataFrame, sheet: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Add or update properties from ``(ord, header, <columns>)``, matched on the exact header.

    The last row of a header wins as a whole. Blank and ``nan`` cells, and unreadable numbers,
    keep the old value. A property that changes its type is cast as far as possible.
    """
    sheet = sheet.withColumn("header", stripped(F.col("header")))
    latest = latest_rows(sheet, "header", "ord")
    fresh = {name: f"__new{k}" for k, (name, _) in enumerate(columns)}
    joined = nodes.join(latest.select("header", *[F.col(n).alias(a) for n, a in fresh.items()]), "header", "left")
    for name, kind in columns:
        cell = F.col(fresh[name]).cast("string")
        blank = stripped(cell).isin("") | (F.lower(stripped(cell)) == "nan")
        value = F.when(~blank, cell)
        target = "double" if kind == "number" else "string"
        old = F.col(name).try_cast(target) if name in nodes.columns else F.lit(None).cast(target)
        joined = joined.withColumn(name, F.coalesce(value.try_cast(target), old))
    kept = [*nodes.columns, *[n for n, _ in columns if n not in nodes.columns]]
    return joined.select(*kept)


def upload_counters(nodes: DataFrame, sheet: DataFrame) -> DataFrame:
    """Matched nodes and ignored rows of an upload."""
    keyed = sheet.select(stripped(F.col("header")).alias("header"))
    known = nodes.select("header", F.lit(True).alias("known"))
    # Sheets repeat headers, so they are counted per header before the join.
    return (
        keyed.groupBy("header")
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(known, "header", "left")
        .agg(
            F.count_if("known").alias("matched_nodes"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("rows"))), F.lit(0)).alias("ignored_rows"),
        )
    )


def without_properties(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Drop properties by case-insensitive name, all of them or none."""
    drop = []
    for name in names:
        if name.lower() == "all" or name.lower() in PROTECTED:
            raise ValueError(f"{name!r} cannot be deleted")
        matches = [c for c in nodes.columns if c.lower() == name.lower()]
        if len(matches) != 1:
            raise ValueError(f"property {name!r} is {'ambiguous' if matches else 'unknown'}")
        drop += matches
    return nodes.drop(*drop)


def edited_cell(nodes: DataFrame, node_id: int, name: str, value: str) -> DataFrame:
    """Set one cell; a blank clears it and a number column takes only numbers."""
    kind = nodes.schema[name].dataType
    if value.strip() == "":
        new = F.lit(None).cast(kind)
    elif isinstance(kind, T.NumericType):
        new = F.lit(float(value)).cast(kind)
    else:
        new = F.lit(value)
    return nodes.withColumn(name, F.when(F.col("node_id") == node_id, new).otherwise(F.col(name)))


def filtered_table(table: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows whose displayed text contains every filter text, in any case."""
    keep = F.lit(True)
    for name, text in filters.items():
        keep = keep & F.contains(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(text.lower()))
    return table.where(keep)


def sorted_table(table: DataFrame, name: str, descending: bool = False) -> DataFrame:
    """Typed sort with missing values first (last when descending)."""
    return table.orderBy(F.desc_nulls_last(name) if descending else F.asc_nulls_first(name))


def default_lengths(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Length property: by full header, else by first token, else 0."""
    from simloom.functions.headers import first_token

    size = F.length("sequence")
    full = records.groupBy("header").agg(F.max_by(size, "ord").alias("by_header"))
    token = records.groupBy(first_token(F.col("header")).alias("token")).agg(F.max_by(size, "ord").alias("by_token"))
    return (
        nodes.withColumn("token", first_token(F.col("header")))
        .join(full, "header", "left")
        .join(token, "token", "left")
        .select(*nodes.columns, F.coalesce("by_header", "by_token", F.lit(0)).alias("Length"))
    )


def json_rows(nodes: DataFrame) -> DataFrame:
    """Node rows as JSON texts; missing numbers become blank texts."""
    shown = [
        F.coalesce(F.when(~F.isnan(F.col(f.name).cast("double")), F.col(f.name).cast("string")), F.lit("")).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in nodes.schema.fields
    ]
    return nodes.select("node_id", F.to_json(F.struct(*shown)).alias("row"))


def export_sheet(nodes: DataFrame, properties: list[str], keep_empty: bool = False) -> DataFrame:
    """Text columns for a sheet; nodes without any value are dropped unless asked for."""
    rows = nodes.select("header", *[F.col(p).cast("string").alias(p) for p in properties])
    if keep_empty:
        return rows
    return rows.where(F.coalesce(*[F.nullif(stripped(F.col(p)), F.lit("")) for p in properties]).isNotNull())


# -- groups ------------------------------------------------------------------------------------

# Fixed value: words a group must not be called.
RESERVED_GROUPS = {
    "noise", "reset", "remove", "delete", "list", "help", "cluster", "group", "groups", "clusters",
}


def checked_group_name(name: str) -> str:
    lowered = name.strip().lower()
    generated = re.fullmatch(r"cluster_[1-9]\d*|subcluster_[1-9]\d*_[1-9]\d*", lowered)
    if not lowered or lowered in RESERVED_GROUPS or generated:
        raise ValueError(f"group name {name!r} is reserved")
    if re.search(r"[#@\"{}\s]", lowered):
        raise ValueError(f"group name {name!r} has characters that expressions reserve")
    return lowered


def _groups(changed: Column) -> Column:
    return F.array_sort(F.array_distinct(changed))


def with_group(nodes: DataFrame, members: Column, name: str) -> DataFrame:
    """Add a group to all nodes for which ``members`` is true."""
    added = _groups(F.array_append("groups", F.lit(checked_group_name(name))))
    return nodes.withColumn("groups", F.when(members, added).otherwise(F.col("groups")))


def without_groups(nodes: DataFrame, names: list[str]) -> DataFrame:
    gone = F.array(*[F.lit(n.lower()) for n in names])
    return nodes.withColumn("groups", F.array_except("groups", gone))


def without_subclusters(nodes: DataFrame, number: int) -> DataFrame:
    """Drop the ``subcluster_<number>_<k>`` groups of an earlier run."""
    pattern = rf"^subcluster_{number}_\d+$"
    return nodes.withColumn("groups", F.filter("groups", lambda g: ~g.rlike(pattern)))


def group_counts(nodes: DataFrame) -> DataFrame:
    """``(name, nodes)`` per group, to be shown by falling count, then name."""
    return nodes.select(F.explode("groups").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("nodes"))


# -- colours and render order ------------------------------------------------------------------


def color_scale(nodes: DataFrame, matched: Column, value: str) -> DataFrame:
    """Position of a numeric property on a colour scale over the visible matches.

    ``scale`` is 0..1 (0.5 if all values agree) and NULL outside the matches; ``gray`` marks
    matches without a value.
    """
    number = F.col(value).try_cast("double")
    number = F.when(~F.isnan(number), number)
    hit = F.coalesce(matched & F.col("visible"), F.lit(False))
    low = nodes.where(hit).agg(F.min(number)).scalar()
    high = nodes.where(hit).agg(F.max(number)).scalar()
    scale = F.when(high == low, F.lit(0.5)).otherwise((number - low) / F.nullif(high - low, F.lit(0.0)))
    return nodes.select(
        "*",
        F.when(hit & number.isNotNull(), scale).alias("scale"),
        (hit & number.isNull()).alias("gray"),
    )


# Fixed values of the cluster palette: hue steps, saturation and lightness range.
HUE_STEPS, SATURATION, LIGHTNESS, LIGHTNESS_LOW, LIGHTNESS_SPAN = 12, 0.65, 0.65, 0.58, 0.27


def cluster_palette(clusters: DataFrame) -> DataFrame:
    """``(cluster, hue, lightness, red, green, blue)`` by sorted cluster position, noise left out.

    As few shades as needed share evenly spread hues; all hues of one shade come first.
    """
    from simloom.plans.numbering import dense_index_by_id

    distinct = clusters.where("cluster <> -1").select("cluster").distinct()
    total = distinct.agg(F.count(F.lit(1))).scalar()
    shades = F.ceil(total / HUE_STEPS)
    hues = F.ceil(total / shades)
    placed = dense_index_by_id(distinct, "place", "cluster").withColumns({"__shades": shades, "__hues": hues})
    shade = F.floor(F.col("place") / F.col("__hues"))
    spread = LIGHTNESS_LOW + shade / F.nullif(F.col("__shades") - 1, F.lit(0)) * LIGHTNESS_SPAN
    toned = placed.select(
        "cluster",
        ((F.col("place") % F.col("__hues")) / F.col("__hues")).alias("hue"),
        F.when(F.col("__shades") == 1, F.lit(LIGHTNESS)).otherwise(spread).alias("lightness"),
    )
    # Lightness is above one half throughout, so the upper branch of the HLS cone applies.
    high = F.col("lightness") + SATURATION - F.col("lightness") * SATURATION
    low = 2 * F.col("lightness") - high

    def channel(shift: float) -> Column:
        h = F.pmod(F.col("hue") + shift, F.lit(1.0))
        return (
            F.when(h < 1 / 6, low + (high - low) * h * 6)
            .when(h < 1 / 2, high)
            .when(h < 2 / 3, low + (high - low) * (2 / 3 - h) * 6)
            .otherwise(low)
        )

    return toned.withColumns({"red": channel(1 / 3), "green": channel(0.0), "blue": channel(-1 / 3)})


def promoted_order(nodes: DataFrame, promoted: Column) -> DataFrame:
    """New ``render_rank``: others keep their order, promoted nodes follow by index."""
    from simloom.plans.numbering import dense_index, id_bucket

    hit = F.coalesce(promoted, F.lit(False))
    place = F.when(hit, F.col("node_id")).otherwise(F.col("render_rank"))
    staged = nodes.withColumns({"__top": hit, "__place": place}).drop("render_rank")
    return dense_index(
        staged, "render_rank", [F.col("__top").cast("int"), id_bucket("__place")], [F.col("__place")]
    ).drop("__top", "__place")


def effective_order(nodes: DataFrame, selected: DataFrame, connected: DataFrame, clicked: int) -> DataFrame:
    """Drawing order: base, then neighbours of the selection, then the selection, then the click."""
    from simloom.plans.numbering import dense_index, id_bucket

    tier = (
        F.when(F.col("node_id") == clicked, 3).when(F.col("__sel"), 2).when(F.col("__con"), 1).otherwise(0)
    )
    staged = (
        nodes.join(selected.select("node_id", F.lit(True).alias("__sel")), "node_id", "left")
        .join(connected.select("node_id", F.lit(True).alias("__con")), "node_id", "left")
        .withColumn("tier", tier)
        .drop("__sel", "__con")
    )
    return dense_index(staged, "draw_rank", [F.col("tier"), id_bucket("render_rank")], [F.col("render_rank")])


def order_violations(nodes: DataFrame) -> DataFrame:
    """One row: is ``render_rank`` a permutation of 0..n-1."""
    ranks = nodes.groupBy("render_rank").agg(F.count(F.lit(1)).alias("n"))
    return ranks.agg(
        F.sum("n").alias("nodes"),
        F.sum(F.col("n") - 1).alias("repeated"),
        F.count_if((F.col("render_rank") < 0) | F.col("render_rank").isNull()).alias("negative"),
        F.max("render_rank").alias("highest"),
    )
