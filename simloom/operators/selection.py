"""Node selection by boolean expressions with three-valued logic.

An expression combines atoms with ``! & ^ |`` (in that order of precedence) and parentheses:

====================  =====================================================================
``"text"``            header contains the text or matches it as a wildcard
``@file@``            header is listed; ``@[NCBI]file@`` / ``@[PDB]file@`` compare accessions
``#cluster_3#``       cluster number, ``#noise#`` or group name
``{Length>500}``      metadata comparison, range (``=1-9``) or text match
``P106``, ``K(-1)``   residue at a displayed position, ``_`` for a gap
====================  =====================================================================

Only residue atoms of nodes without an alignment row are unknown (NULL); all other atoms are
known for every node. The result keeps the nodes for which the expression is TRUE.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions.headers import accession, header_contains, structure_ids, wildcard_match
from simloom.sources.lists import read_header_list

SUGGESTIONS = 10

# Fixed formats of the atoms.
_ATOM = re.compile(
    r'"(?P<text>[^"]+)"'
    r"|@(?P<file>[^@]+)@"
    r"|\{(?P<meta>[^}]+)\}"
    r"|#(?P<label>[^#]+)#"
    r"|(?<!\w)(?P<aa>[a-zA-Z_])(?:\((?P<neg>-\d+(?:\.\d+)?)\)|(?P<pos>[\d.]+))(?![\w.])"
)
_BARE_NEGATIVE = re.compile(r"(?<!\w)([a-zA-Z_])(-\d+(?:\.\d+)?)(?![\w.])")
_COMPARISON = re.compile(r"([a-zA-Z0-9_\-]+)\s*(>=|<=|!=|==|>|<|=)\s*(.*)")


class SelectionExpressionError(ValueError):
    """The expression text is malformed."""


class SelectionContextError(SelectionExpressionError):
    """The expression names a cluster, group, position, property or file that does not exist."""


@dataclass
class SelectionContext:
    """Data an expression is evaluated against.

    ``nodes``: ``(node_id, header, [cluster INT], [groups ARRAY<STRING>], [visible BOOLEAN])``
    plus one column per metadata property named in ``properties``.
    ``rows``: ``(node_id, row_id)`` for aligned nodes; ``cells``: ``(row_id, col, aa)`` without
    gaps; ``labels``: ``(col, label)``.
    """

    nodes: DataFrame
    properties: list[str] = field(default_factory=list)
    rows: DataFrame | None = None
    cells: DataFrame | None = None
    labels: DataFrame | None = None
    files: dict[str, DataFrame] = field(default_factory=dict)
    file_dir: str | None = None
    strip_spaces: bool = True


def select_nodes(context: SelectionContext, expression: str) -> DataFrame:
    """Nodes for which the expression is TRUE, with their original columns."""
    frame, condition = compile_expression(context, expression)
    return frame.where(condition).select(*context.nodes.columns)


def with_match(context: SelectionContext, expression: str, out: str = "matched") -> DataFrame:
    """All nodes with a BOOLEAN match column."""
    frame, condition = compile_expression(context, expression)
    return frame.select(*context.nodes.columns, F.coalesce(condition, F.lit(False)).alias(out))


def compile_expression(context: SelectionContext, expression: str) -> tuple[DataFrame, Column]:
    """Node frame extended by the lookups the atoms need, and the condition on it."""
    if not isinstance(expression, str) or not expression.strip():
        raise SelectionExpressionError("selection expression is empty")
    lookups = _Lookups(context)
    atoms: dict[str, Column] = {}

    def replace(match: re.Match) -> str:
        name = f"atom{len(atoms)}_"
        atoms[name] = lookups.atom(match)
        return f" {name} "

    text = _ATOM.sub(replace, expression)
    bare = _BARE_NEGATIVE.search(text)
    if bare:
        aa, position = bare.groups()
        raise SelectionExpressionError(f"write the negative position {aa}{position} as {aa}({position})")
    condition = boolean_column(text, atoms)
    return lookups.frame(), condition


def boolean_column(text: str, atoms: dict[str, Column]) -> Column:
    """Combine named boolean columns by ``! & ^ |``; NULL is unknown.

    Python's own grammar already has the wanted precedence, so its syntax tree is read and
    anything beyond these operators is refused. Nothing is evaluated.
    """
    combine: dict[type, Callable[[Column, Column], Column]] = {
        ast.BitAnd: lambda a, b: a & b,
        ast.BitOr: lambda a, b: a | b,
        ast.BitXor: lambda a, b: a != b,
    }

    def column(node: ast.expr) -> Column:
        if isinstance(node, ast.Name) and node.id in atoms:
            return atoms[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Invert):
            return ~column(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in combine:
            return combine[type(node.op)](column(node.left), column(node.right))
        raise SelectionExpressionError("invalid boolean expression: check operators and parentheses")

    try:
        tree = ast.parse(text.replace("!", "~").strip(), mode="eval")
    except SyntaxError as error:
        raise SelectionExpressionError("invalid boolean expression: check operators and parentheses") from error
    return column(tree.body)


class _Lookups:
    """Atoms of one expression and the joins that supply their columns."""

    def __init__(self, context: SelectionContext):
        self.context = context
        self.positions: dict[int, str] = {}
        self.markers: list[tuple[Column, DataFrame, str]] = []

    def atom(self, match: re.Match) -> Column:
        kind = match.lastgroup if match.lastgroup not in {"neg", "pos"} else "aa"
        if kind == "aa":
            return self._residue(match["aa"], match["neg"] or match["pos"])
        return getattr(self, f"_{kind}")(match[kind])

    def frame(self) -> DataFrame:
        nodes = self.context.nodes
        for column, keys, out in self.markers:
            marked = keys.distinct().withColumn(out, F.lit(True))
            nodes = nodes.withColumn("__key", column).join(
                marked.withColumnRenamed(keys.columns[0], "__key"), "__key", "left"
            ).drop("__key")
        if self.positions:
            # One pass over the needed alignment columns only, one row per aligned sequence.
            residues = (
                self.context.cells.where(F.col("col").isin(list(self.positions)))
                .groupBy("row_id")
                .agg(*[F.max(F.when(F.col("col") == c, F.upper("aa"))).alias(n) for c, n in self.positions.items()])
            )
            aligned = self.context.rows.select("node_id", "row_id").join(residues, "row_id", "left")
            nodes = nodes.join(aligned.withColumnRenamed("row_id", "__row"), "node_id", "left")
        return nodes

    # -- atoms -----------------------------------------------------------------------------

    def _text(self, target: str) -> Column:
        return header_contains(F.col("header"), target)

    def _file(self, target: str) -> Column:
        name = target.strip()
        mode = next((m for m in ("[ncbi]", "[pdb]") if name.lower().startswith(m)), "")
        listed = self._file_headers(name[len(mode):])
        out = f"__file{len(self.markers)}"
        if mode == "[ncbi]":
            keys = listed.select(F.lower(accession(F.col("header"), ignore_case=True)).alias("k"))
            self.markers.append((F.lower(accession(F.col("header"), ignore_case=True)), keys.where("k IS NOT NULL"), out))
        elif mode == "[pdb]":
            wanted = listed.select(F.get(structure_ids(F.col("header")), F.lit(0)).alias("k")).where("k IS NOT NULL")
            owners = (
                self.context.nodes.select("node_id", F.explode(structure_ids(F.col("header"))).alias("k"))
                .join(wanted, "k", "left_semi")
                .select("node_id")
            )
            self.markers.append((F.col("node_id"), owners, out))
        else:
            self.markers.append((F.lower("header"), listed.select(F.lower("header").alias("k")), out))
        return F.coalesce(F.col(out), F.lit(False))

    def _file_headers(self, name: str) -> DataFrame:
        if name in self.context.files:
            return self.context.files[name]
        if self.context.file_dir is None:
            raise SelectionContextError(f"selection file {name!r} does not exist")
        return read_header_list(self.context.nodes.sparkSession, self.context.file_dir, name)

    def _label(self, target: str) -> Column:
        name = target.strip().lower()
        cluster = re.fullmatch(r"cluster_(\d+)", name)
        nodes = self.context.nodes
        if name == "noise" or cluster:
            if "cluster" not in nodes.columns:
                raise SelectionContextError("no clusters are defined")
            number = -1 if name == "noise" else int(cluster.group(1))
            found = F.col("cluster") == number
            if nodes.where(found).isEmpty():
                known = F.when(F.col("cluster") == -1, "noise").otherwise(F.concat(F.lit("cluster_"), "cluster"))
                raise SelectionContextError(f"{name!r} does not exist. " + self._known(nodes.select(known.alias("k"))))
            return F.coalesce(found, F.lit(False))
        if "groups" not in nodes.columns:
            raise SelectionContextError("no groups are defined")
        found = F.array_contains("groups", F.lit(name))
        if nodes.where(found).isEmpty():
            known = nodes.select(F.explode("groups").alias("k"))
            raise SelectionContextError(f"group {name!r} does not exist. " + self._known(known))
        return F.coalesce(found, F.lit(False))

    def _residue(self, aa: str, position: str) -> Column:
        if not re.fullmatch(r"-?\d+(?:\.\d+)?", position):
            raise SelectionExpressionError(f"{position!r} is not a position label")
        context = self.context
        if context.labels is None:
            raise SelectionContextError(f"no alignment is loaded for {aa}{position}")
        hit = context.labels.where(F.col("label") == position).select("col").first()
        if hit is None:
            known = context.labels.select(F.col("label").alias("k"))
            raise SelectionContextError(f"position {position!r} does not exist. " + self._known(known))
        name = self.positions.setdefault(hit["col"], f"__col{hit['col']}")
        residue = F.col(name)
        found = residue.isNull() if aa == "_" else F.coalesce(residue == aa.upper(), F.lit(False))
        return F.when(F.col("__row").isNotNull(), found)

    def _meta(self, target: str) -> Column:
        context = self.context
        if not context.properties:
            raise SelectionContextError("no metadata is loaded")
        parsed = _COMPARISON.fullmatch((target.replace(" ", "") if context.strip_spaces else target).strip())
        if not parsed:
            raise SelectionExpressionError(f"invalid metadata predicate {{{target}}}")
        key, op, value = parsed[1], parsed[2], parsed[3].strip()
        if not value:
            raise SelectionExpressionError(f"metadata predicate {{{target}}} has no value")
        name = next((p for p in context.properties if p.lower() == key.lower()), None)
        if name is None:
            listed = ", ".join(sorted(context.properties, key=str.lower)[:SUGGESTIONS])
            raise SelectionContextError(f"property {key!r} does not exist. Available: {listed}")
        if isinstance(context.nodes.schema[name].dataType, T.NumericType):
            return compare_number(F.col(name), op, value)
        if op not in ("=", "==", "!="):
            raise SelectionExpressionError(f"operator {op} is not supported for text property {name!r}")
        return compare_text(F.col(name), op, value)

    @staticmethod
    def _known(values: DataFrame) -> str:
        """Sorted, bounded list of what could have been named instead."""
        first = values.groupBy("k").count().orderBy(F.lower("k")).limit(SUGGESTIONS).collect()
        return "Available: " + ", ".join(str(r["k"]) for r in first) if first else "None are available."


def compare_number(column: Column, op: str, value: str) -> Column:
    """Numeric comparison that is known for every row: missing never matches, except ``!=``."""
    column = F.when(~F.isnan(column.cast("double")), column.cast("double"))
    try:
        number = float(value)
    except ValueError:
        low, dash, high = value.partition("-")
        try:
            bounds = float(low), float(high)
        except ValueError:
            bounds = None
            # "a-b-c" style ranges pass validation on the first dash but never match.
            if not (op in ("=", "==") and dash and value.count("-") > 1):
                raise SelectionExpressionError(f"{value!r} is not numeric") from None
        if op not in ("=", "=="):
            raise SelectionExpressionError(f"{value!r} is not numeric")
        if bounds is None or value.count("-") > 1:
            return F.lit(False)
        return F.coalesce(column.between(*map(F.lit, bounds)), F.lit(False))
    number = F.lit(number)
    if op == "!=":
        return F.coalesce(column != number, F.lit(True))
    compared = {
        ">": column > number,
        "<": column < number,
        ">=": column >= number,
        "<=": column <= number,
        "=": column == number,
        "==": column == number,
    }[op]
    return F.coalesce(compared, F.lit(False))


def compare_text(column: Column, op: str, value: str) -> Column:
    """Case-insensitive substring, or wildcard if the value has ``*`` or ``?``."""
    text, target = F.lower(F.coalesce(column, F.lit(""))), value.lower()
    if "*" in target or "?" in target:
        found = wildcard_match(text, target)
    else:
        found = F.contains(text, F.lit(target.strip("\"'")))
    return ~found if op == "!=" else found


# -- combining a new match with the current selection ------------------------------------------


def combine_selection(current: DataFrame, matched: DataFrame, mode: str) -> DataFrame:
    """Selected ``node_id`` rows after ``change``, ``add``, ``subtract`` or ``filter``."""
    current, matched = current.select("node_id"), matched.select("node_id")
    if mode == "change":
        return matched
    if mode in {"add", "plus", "include"}:
        return current.union(matched).distinct()
    if mode in {"subtract", "minus", "remove"}:
        return current.join(matched, "node_id", "left_anti")
    if mode in {"filter", "keep", "intersect"}:
        return current.join(matched, "node_id", "left_semi")
    raise ValueError(f"unknown selection mode {mode!r}")


def invert_selection(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """Visible nodes that are not selected."""
    return nodes.where("visible").select("node_id").join(current.select("node_id"), "node_id", "left_anti")
