"""Interactive session: immutable DataFrames as state, with undo and redo.

Each command derives a new ``nodes`` DataFrame from the current one. History keeps references
to earlier frames (they are plans, not copies), bounded as below. Every expression of a command
is compiled before anything changes, so a failing command changes nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.operators import alignment, graph, metadata, network
from simloom.operators.selection import (
    SelectionContext,
    combine_selection,
    compile_expression,
    invert_selection,
    select_nodes,
)

HISTORY = 50

# Visual state of a new node.
DEFAULTS = {"color": "gray", "size": 1.0, "shape": "disc"}


# A word of a command line may hold quoted blanks; a comment begins outside of quotes.
_WORDS = re.compile(r'(?:"[^"]*"|[^\s"])+')
_COMMENT = re.compile(r'("[^"]*")|//.*')
MODES = {"change", "add", "plus", "include", "subtract", "minus", "remove", "filter", "keep", "intersect"}


@dataclass(frozen=True)
class State:
    nodes: DataFrame
    selected: DataFrame


class Session:
    """A network with node state, an optional alignment and a current selection."""

    def __init__(
        self,
        nodes: DataFrame,
        edges: DataFrame,
        properties: list[str] | None = None,
        rows: DataFrame | None = None,
        cells: DataFrame | None = None,
        n_cols: int | None = None,
        file_dir: str | None = None,
    ):
        start = {
            "visible": F.lit(True),
            "groups": F.array().cast("array<string>"),
            "render_rank": F.col("node_id"),
            **{name: F.lit(value) for name, value in DEFAULTS.items()},
        }
        nodes = nodes.withColumns({n: c for n, c in start.items() if n not in nodes.columns})
        self.edges = edges
        self.properties = list(properties or [])
        self.rows, self.cells, self.n_cols = rows, cells, n_cols
        self.file_dir = file_dir  # folder of the header lists that ``@name@`` reads
        self.labels: DataFrame | None = None
        self.reference: str | None = None
        self.offset = 0
        self._state = State(nodes, nodes.select("node_id").limit(0))
        self._past: list[State] = []
        self._future: list[State] = []
        if rows is not None:
            self.set_reference(None)

    # -- state ---------------------------------------------------------------------------------

    @property
    def nodes(self) -> DataFrame:
        return self._state.nodes

    @property
    def selected(self) -> DataFrame:
        return self._state.selected

    def _advance(self, **changes) -> None:
        self._past = [*self._past, self._state][-HISTORY:]
        self._future = []
        self._state = replace(self._state, **changes)

    def undo(self) -> bool:
        if not self._past:
            return False
        self._future.append(self._state)
        self._state = self._past.pop()
        return True

    def redo(self) -> bool:
        if not self._future:
            return False
        self._past.append(self._state)
        self._state = self._future.pop()
        return True

    def context(self, nodes: DataFrame | None = None) -> SelectionContext:
        nodes = self.nodes if nodes is None else nodes
        rows = None
        if self.rows is not None:
            mapped = alignment.rows_for_nodes(nodes, self.rows)
            rows = mapped.where("row_id >= 0")
        chosen = nodes.join(self.selected, "node_id", "left_semi").select("header")
        return SelectionContext(
            nodes, self.properties, rows, self.cells, self.labels, {"_sele.txt": chosen}, self.file_dir
        )

    def _expression(self, text: str) -> str:
        return re.sub(r"\"?\$sele\$\"?", "@_sele.txt@", text, flags=re.IGNORECASE)

    def matched(self, text: str, nodes: DataFrame | None = None) -> DataFrame:
        return select_nodes(self.context(nodes), self._expression(text)).select("node_id")

    def _flagged(self, nodes: DataFrame, text: str, flag: str) -> DataFrame:
        frame, condition = compile_expression(self.context(nodes), self._expression(text))
        return frame.select(*nodes.columns, F.coalesce(condition, F.lit(False)).alias(flag))

    # -- selection and visibility --------------------------------------------------------------

    def select(self, text: str, mode: str = "change") -> DataFrame:
        visible = self.nodes.where("visible").select("node_id")
        matched = self.matched(text).join(visible, "node_id", "left_semi")
        self._advance(selected=combine_selection(self.selected, matched, mode))
        return self.selected

    def invert(self) -> DataFrame:
        self._advance(selected=invert_selection(self.nodes, self.selected))
        return self.selected

    def hide(self, text: str, slider: float = float("-inf")) -> DataFrame:
        """Hide matches, or with ``single``/``free`` the visible nodes without an active edge."""
        if text.lower() in {"single", "free"}:
            active = network.visible_edges(self.edges, self.nodes, slider)
            lonely = network.isolated(self.nodes.where("visible"), active).select("node_id")
            hit = lonely.withColumn("__hit", F.lit(True))
            flagged = self.nodes.join(hit, "node_id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
        else:
            flagged = self._flagged(self.nodes, text, "__hit")
        nodes = flagged.withColumn("visible", F.col("visible") & ~F.col("__hit")).drop("__hit")
        shown = nodes.where("visible").select("node_id")
        self._advance(nodes=nodes, selected=self.selected.join(shown, "node_id", "left_semi"))
        return self.nodes

    # -- appearance ----------------------------------------------------------------------------

    def color(self, *assignments: tuple[str, dict]) -> DataFrame:
        """Assign colour, size and shape by expression; matched nodes come to the front."""
        nodes, columns, touched = self.nodes, self.nodes.columns, F.lit(False)
        for k, (text, _) in enumerate(assignments):
            nodes = nodes.join(
                self._flagged(self.nodes, text, f"__hit{k}").select("node_id", f"__hit{k}"), "node_id"
            )
        for k, (_, values) in enumerate(assignments):
            hit = F.col(f"__hit{k}")
            touched = touched | hit
            for name, value in values.items():
                nodes = nodes.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
        promoted = metadata.promoted_order(nodes.withColumn("__touched", touched), F.col("__touched"))
        self._advance(nodes=promoted.select(*columns))
        return self.nodes

    def spectrum(self, text: str, value: str) -> DataFrame:
        """Scale positions of a numeric property over the visible matches."""
        flagged = self._flagged(self.nodes, text, "__hit")
        scaled = metadata.color_scale(flagged, F.col("__hit"), value).drop("__hit")
        self._advance(nodes=scaled)
        return self.nodes

    def reset(self, *targets: str) -> DataFrame:
        nodes = self.nodes
        for target in targets:
            name = target.lower().removesuffix("s")
            if name in DEFAULTS:
                nodes = nodes.withColumn(name, F.lit(DEFAULTS[name]))
            elif name == "cluster":
                nodes = nodes.drop("cluster")
            elif name == "group":
                nodes = nodes.withColumn("groups", F.array().cast("array<string>"))
            elif name in {"hide", "hidden"}:
                nodes = nodes.withColumn("visible", F.lit(True))
            elif name in {"order", "layer"}:
                nodes = nodes.withColumn("render_rank", F.col("node_id"))
            else:
                raise ValueError(f"unknown reset target {target!r}")
        self._advance(nodes=nodes)
        return self.nodes

    # -- clusters and groups -------------------------------------------------------------------

    def cluster(self, mode: str = "leiden", parameter: float = 1.0, min_size: int = 10) -> DataFrame:
        found = graph.clusters(self.nodes, self.edges, mode, parameter, min_size)
        self._advance(nodes=self.nodes.drop("cluster").join(found, "node_id"))
        return graph.cluster_sizes(self.nodes)

    def subcluster(self, number: int, mode: str, parameter: float, min_size: int) -> DataFrame:
        self._advance(nodes=graph.subclusters(self.nodes, self.edges, number, mode, parameter, min_size))
        return metadata.group_counts(self.nodes)

    def group(self, *pairs: tuple[str, str]) -> DataFrame:
        """Add groups by expression; a later pair may refer to an earlier one."""
        nodes = self.nodes
        for text, name in pairs:
            metadata.checked_group_name(name)
            flagged = self._flagged(nodes, text, "__hit")
            nodes = metadata.with_group(flagged, F.col("__hit"), name).drop("__hit")
        self._advance(nodes=nodes)
        return metadata.group_counts(self.nodes)

    def remove_groups(self, *names: str) -> DataFrame:
        self._advance(nodes=metadata.without_groups(self.nodes, list(names)))
        return metadata.group_counts(self.nodes)

    # -- metadata ------------------------------------------------------------------------------

    def upload(self, sheet: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
        """Merge a sheet and report matched and ignored rows."""
        report = metadata.upload_counters(self.nodes, sheet)
        self._advance(nodes=metadata.merged_metadata(self.nodes, sheet, columns))
        self.properties += [name for name, _ in columns if name not in self.properties]
        return report

    def delete_properties(self, *names: str) -> None:
        self._advance(nodes=metadata.without_properties(self.nodes, list(names)))
        self.properties = [p for p in self.properties if p in self.nodes.columns]

    def edit(self, node_id: int, name: str, value: str) -> None:
        self._advance(nodes=metadata.edited_cell(self.nodes, node_id, name, value))

    # -- alignment -----------------------------------------------------------------------------

    def set_reference(self, wanted: str | None, min_occupancy: float = 0.0) -> DataFrame:
        """Number positions by a reference row, or by occupancy without one."""
        n_rows = self.rows.count()
        if wanted is None:
            columns = alignment.valid_columns(self.cells, n_rows, min_occupancy)
            self.labels, self.reference, self.offset = alignment.occupancy_labels(columns), None, 0
            return self.labels
        row = alignment.reference_row(self.rows, wanted)
        if row.isEmpty():
            raise ValueError(f"no alignment row matches {wanted!r}")
        columns = alignment.valid_columns(self.cells, n_rows, min_occupancy, row)
        self._reference_args = (self.cells, row, self.n_cols, columns)
        self.labels = alignment.reference_labels(*self._reference_args)
        self.reference, self.offset = wanted, 0
        return self.labels

    def set_offset(self, offset: int) -> DataFrame:
        """Shift reference numbering; always from the unshifted labels."""
        if self.reference is None:
            raise ValueError("an offset needs a reference")
        if isinstance(offset, bool) or int(offset) != offset:
            raise ValueError("the offset must be an integer")
        self.labels = alignment.reference_labels(*self._reference_args, offset=int(offset))
        self.offset = int(offset)
        return self.labels

    def _rows_of(self, text: str | None) -> tuple[DataFrame, Column]:
        rows = alignment.rows_for_nodes(self.nodes, self.rows).where("row_id >= 0")
        if text is not None:
            rows = rows.join(self.matched(text), "node_id", "left_semi")
            ids = rows.select("row_id").distinct()
        else:
            ids = self.rows.select("row_id")
        return ids, ids.agg(F.count(F.lit(1))).scalar()

    def query(self, spec: str, text: str | None = None) -> DataFrame:
        """Residue breakdown at positions, or positions that satisfy a frequency logic."""
        ids, total = self._rows_of(text)
        cells = self.cells if text is None else self.cells.join(ids, "row_id", "left_semi")
        counts = alignment.residue_counts(cells)
        if any(op in spec for op in "<>"):
            found = alignment.frequency_search(counts, total, self.labels, spec)
            return alignment.breakdown(counts, total, found)
        return alignment.positions_breakdown(counts, total, self.labels, spec)

    def logo(self, text: str | None = None, identity: float | None = None, **options) -> DataFrame:
        """Letter heights over the rows of a selection."""
        from simloom.operators.identity import identity_weights

        ids, _ = self._rows_of(text)
        rows = self.rows.join(ids, "row_id", "left_semi")
        cells = self.cells.join(ids, "row_id", "left_semi")
        weights = None
        if identity is not None:
            weights = identity_weights(alignment.aligned_text(rows, cells, self.n_cols), identity)
        return alignment.logo_matrix(cells, rows, weights=weights, **options)

    def label(self, target: str = "all", subset_min: float = 0.98, outside_max: float = 0.40) -> DataFrame:
        """Subset-specific residues of clusters, groups or both, as report cells."""
        rows = alignment.rows_for_nodes(self.nodes, self.rows)
        parts = []
        if target in {"all", "clusters"} and "cluster" in self.nodes.columns:
            parts.append(alignment.cluster_memberships(self.nodes, rows))
        if target in {"all", "groups"}:
            parts.append(alignment.group_memberships(self.nodes, rows))
        members = parts[0]
        for part in parts[1:]:
            members = members.unionByName(part)
        found = alignment.subset_specific_residues(self.cells, self.rows, members, subset_min, outside_max)
        return alignment.subset_cells_text(found, self.labels)

    def run(self, lines: list[str]) -> int:
        """Run a command script: blank lines and ``//`` comments skipped, one command per line.

        Commands are the text forms of the methods: ``select [mode] <expression>``, ``hide``, ``cluster``, ``group <expression> <name> ...``,
        ``reference [row]``, ``offset``, ``spectrum <expression> <property>``, ``reset``, ``undo`` and ``redo``. Blanks and ``//`` inside quotes belong
        to the quoted text.
        """
        done = 0
        for line in lines:
            words = _WORDS.findall(_COMMENT.sub(lambda found: found[1] or "", line))
            if not words:
                continue
            name, args = words[0].lower(), words[1:]
            if name == "select":
                if args == ["invert"]:
                    self.invert()
                elif len(args) > 1 and args[0].lower() in MODES:
                    self.select(" ".join(args[1:]), args[0].lower())
                else:
                    self.select(" ".join(args))
            elif name == "hide":
                self.hide(" ".join(args))
            elif name == "cluster":
                self.cluster(args[0], *[float(a) for a in args[1:2]], *[int(a) for a in args[2:3]])
            elif name == "group":
                self.group(*zip(args[::2], (a.strip('"') for a in args[1::2])))
            elif name == "reference":
                self.set_reference(" ".join(args).strip('"') or None)
            elif name == "offset":
                self.set_offset(int(args[0]))
            elif name == "spectrum":
                self.spectrum(" ".join(args[:-1]), args[-1].strip('"'))
            elif name in {"undo", "redo"}:
                getattr(self, name)()
            elif name == "reset":
                self.reset(*args)
            else:
                raise ValueError(f"unknown command {name!r}")
            done += 1
        return done
