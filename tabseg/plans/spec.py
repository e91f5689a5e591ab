"""Random partitions of feature space: which features an iteration uses and how each is cut.

A Sketch holds only what was drawn (features, uniforms, seeds), so the same sketch can be fitted on any table
and be written out as SQL; fitting it gives a Spec with edges and category maps.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabseg.functions import cuts
from tabseg.functions.profile import numeric_stats
from tabseg.functions.weights import pick_across_groups, weighted_pick
from tabseg.session import hash32

#: Categories of one column up to which a category map is kept on the driver.
CATEGORIES = 1_000_000


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str  # numerical or categorical
    bins: int
    draws: list[float]  # sorted uniforms, bins - 1 of them (numerical)
    seed: str  # of the category permutation


@dataclass(frozen=True)
class Sketch:
    iterations: list[list[Feature]]
    cut: str = "uniform"  # uniform, quantile or density


def draw(kinds: dict[str, str], n_iterations: int, n_features: int | float | str = "sqrt", bins: int | dict[str, int] = 3, seed: int = 42, weights: dict[str, float] | None = None, groups: list[list[str]] | None = None, cut: str = "uniform") -> Sketch:
    """Draw the iterations. bins: one number, or per column. groups: correlation groups of which an iteration uses one column each."""
    rng = np.random.default_rng(seed)
    names = list(kinds)
    m = cuts.resolve_features(n_features, len(names))
    w = weights or {}
    out = []
    for it in range(n_iterations):
        if groups:
            chosen = pick_across_groups(names, groups, {c: w.get(c, 1.0) for c in names}, m, rng)
        else:
            chosen = [names[i] for i in weighted_pick(np.array([w.get(c, 1.0) for c in names]), m, rng)]
        row = []
        for c in chosen:
            k = bins[c] if isinstance(bins, dict) else bins
            u = sorted(float(round(x, 9)) for x in rng.random(k - 1)) if kinds[c] == "numerical" else []
            row.append(Feature(c, kinds[c], k, u, f"{seed}:{it}:{c}"))
        out.append(row)
    return Sketch(out, cut)


@dataclass
class Spec:
    """A fitted sketch: edges of numerical features, bins of categories. A driver object of bounded size."""

    sketch: Sketch
    edges: dict[str, list[float]] = field(default_factory=dict)  # by feature seed
    bins: dict[str, dict[str, int]] = field(default_factory=dict)
    how: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"sketch": asdict(self.sketch), "edges": self.edges, "bins": self.bins, "how": self.how})

    @staticmethod
    def from_json(text: str) -> Spec:
        d = json.loads(text)
        return Spec(Sketch([[Feature(**f) for f in it] for it in d["sketch"]["iterations"]], d["sketch"]["cut"]), d["edges"], d["bins"], d["how"])

    def table(self, spark) -> DataFrame:
        """The specification as rows, for storing: iteration, feature, kind, bins, edges, category map."""
        rows = [(i, f.name, f.kind, f.bins, self.edges.get(f.seed), self.bins.get(f.seed)) for i, it in enumerate(self.sketch.iterations) for f in it]
        return spark.createDataFrame(rows, "l int, feature string, kind string, bins int, edges array<double>, category_bins map<string,int>")


def fit(df: DataFrame, sketch: Sketch, id_col: str | None = None, seed: int = 0, rule: str = "silverman") -> Spec:
    """Fit the sketch on all rows: one pass of statistics, one per used category column."""
    spec = Spec(sketch)
    used = [f for it in sketch.iterations for f in it]
    numeric = sorted({f.name for f in used if f.kind == "numerical"})
    if numeric and sketch.cut == "uniform":
        stats = numeric_stats_light(df, numeric)
        for f in used:
            if f.kind == "numerical":
                spec.edges[f.seed] = cuts.uniform_cuts(stats[f.name], np.array(f.draws))
    elif numeric and sketch.cut == "quantile":
        probs = {c: sorted({u for f in used if f.name == c for u in f.draws}) for c in numeric}
        from tabseg.functions.profile import number
        from tabseg.functions.quantiles import exact_quantiles

        got = exact_quantiles(df.select(*[number(c).alias(c) for c in numeric]), probs)
        at = {c: dict(zip(probs[c], got[c])) for c in numeric}
        for f in used:
            if f.kind == "numerical":
                spec.edges[f.seed] = sorted(at[f.name][u] or 0.0 for u in f.draws)
    elif numeric:
        points = {c: cuts.weighted_points(df, c) for c in numeric}
        for f in used:
            if f.kind == "numerical":
                spec.edges[f.seed], spec.how[f.seed] = cuts.density_cuts(points[f.name][0], f.bins - 1, np.random.default_rng(hash32_int(f.seed)), rule, points[f.name][1])
    for c in sorted({f.name for f in used if f.kind == "categorical"}):
        values = category_values(df, c)
        for f in used:
            if f.name == c and f.kind == "categorical":
                spec.bins[f.seed] = category_bins(values, f.seed, f.bins)
    return spec


def numeric_stats_light(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    from tabseg.functions.profile import number

    r = df.agg(*[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max))]).first()
    return {c: {"min": r[f"a{i}"], "max": r[f"b{i}"]} for i, c in enumerate(cols)}


def category_values(df: DataFrame, col: str) -> list[str]:
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("v")).distinct().orderBy("v").limit(CATEGORIES + 1).collect()
    if len(rows) > CATEGORIES:
        raise ValueError(f"{col} has more than {CATEGORIES} categories; group rare ones first")
    return [r[0] for r in rows]


def hash32_int(text: str) -> int:
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def category_bins(values: list[str], seed: str, k: int) -> dict[str, int]:
    """A random permutation of the categories (by hash), dealt out to k bins in turn."""
    order = sorted(values, key=lambda v: (hash32_int(f"{v}:{seed}"), v))
    return {v: i % k for i, v in enumerate(order)}


def bins_per_column(df: DataFrame, kinds: dict[str, str], mode: str = "adaptive", low: int = 2, high: int = 10) -> dict[str, int]:
    """Adaptive bins of all columns, or (mode 'cap') Sturges bins with categorical ones capped by their values."""
    n = df.count()
    numeric = [c for c, k in kinds.items() if k == "numerical"]
    stats = numeric_stats(df, numeric) if numeric else {}
    cat = [c for c, k in kinds.items() if k != "numerical"]
    r = df.agg(*[F.count_distinct(F.col(c).cast("string")).alias(f"u{i}") for i, c in enumerate(cat)]).first() if cat else {}
    out: dict[str, int] = {}
    for c in kinds:
        if kinds[c] == "numerical":
            out[c] = cuts.adaptive_bins(stats[c], n, low, high) if mode == "adaptive" else cuts.resolve_bins("auto", n, low, high)
        else:
            u = r[f"u{cat.index(c)}"]
            out[c] = cuts.adaptive_bins({"n_unique": u}, n, low, high, True) if mode == "adaptive" else cuts.categorical_cap(u, n, low, high)
    return out


Hash = Callable[..., object]
__all__ = ["Feature", "Sketch", "Spec", "bins_per_column", "category_bins", "category_values", "draw", "fit", "hash32"]
