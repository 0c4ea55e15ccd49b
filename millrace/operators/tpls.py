"""T-shaped projection to latent structures: properties of materials, formulas of lots, conditions and qualities of lots.

Four tables share keys, not rows: D has the properties of materials (long:
group, material, property, value), F the materials of lots (long: lot, group,
material, value), Z the conditions and Y the qualities of lots (wide).  F, Z and
Y are joined by lot once; a lot's materials stay a sparse list.

A component is an alternating iteration after Garcia-Munoz (2014).  The lots'
part of its state is u = Y q / q'q, which any task can make from its own rows and
the few numbers q.  So each iteration is two passes of sums: one by material and
condition (F'u, Z'u, with the u'u of known cells), from which D gives the weights
of materials; and one of the moments of block scores and qualities, by the
pattern of known qualities, from which the inner model is solved.  Earlier
components are taken off row by row within a pass; nothing of the size of the
lots is ever written or sent.

Materials and properties are columns: their number is checked, not the number of
lots.  Cells that are absent or null are missing, or zero for formulas with
absent="zero".  Cells given twice are added (properties: averaged).  Lots must be
in F and Y (and Z, if given); columns without variance count as zeros.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.operators.latent import t2_limit
from millrace.sources.tables import written

#: Materials, and cells of D, that a model takes at most.
MATERIALS, CELLS = 100_000, 10_000_000
TOLERANCE = math.sqrt(np.finfo(float).eps)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0: a regression without known cells."""
    return np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b != 0)


def on_rows(x: np.ndarray, known: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slope of each row's known cells on b."""
    return ratio(x @ b, known @ b**2)


@dataclass
class Component:
    """r, w: weights of materials and conditions; super: of the block scores (Z, F); p, pz, q: loadings; s, v: weights and loadings of properties."""

    r: np.ndarray
    w: np.ndarray
    super: np.ndarray
    q: np.ndarray
    s: np.ndarray
    p: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pz: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros(0))
    iterations: int = 0

    def blocks(self, x: Lots) -> np.ndarray:
        """Block scores of lots, those of Z first."""
        f = on_rows(x.f, x.f_known, self.r)[:, None]
        return np.hstack([on_rows(x.z, x.z_known, self.w)[:, None], f]) if x.z.shape[1] else f

    def take(self, x: Lots) -> np.ndarray:
        """The super scores of lots, whose part is taken off their cells."""
        t = self.blocks(x) @ self.super
        x.f = x.f - np.outer(t, self.p) * x.f_known
        x.z = x.z - np.outer(t, self.pz) * x.z_known
        x.y = x.y - np.outer(t, self.q) * x.y_known
        return t


class Lots:
    """Some lots' scaled cells, 0 where unknown, and which are known."""

    def __init__(self, batch: pa.RecordBatch, model: TPLS):
        n, m = batch.num_rows, len(model.materials)
        f = np.full((n, m), 0.0 if model.absent == "zero" else np.nan)
        at, value = batch.column("at"), batch.column("value")
        f[np.repeat(np.arange(n), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = value.flatten().to_numpy()
        wide = lambda names: np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]) if names else np.zeros((n, 0))
        y = wide(model.y) if set(model.y) <= set(batch.schema.names) else np.full((n, len(model.y)), np.nan)
        (self.f, self.f_known), (self.z, self.z_known), (self.y, self.y_known) = (scaled(x, *model.scales[k]) for k, x in (("F", f), ("Z", wide(model.z)), ("Y", y)))


def scaled(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = ~np.isnan(x)
    return np.where(known, np.nan_to_num((x - center) / scale), 0.0), known.astype(float)


@dataclass
class TPLS:
    materials: list[tuple[str, str]]
    properties: list[tuple[str, str]]
    z: list[str]
    y: list[str]
    absent: str
    scales: dict[str, tuple[np.ndarray, np.ndarray]]
    found: list[Component] = field(default_factory=list)
    n: int = 0
    score_scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    r2: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, d: DataFrame, f: DataFrame, z: DataFrame | None, y: DataFrame, components: int, lot: str = "lot", absent: str = "missing", most: int = 500, tolerance: float = TOLERANCE) -> TPLS:
        cells = d.groupBy("group", "material", "property").agg(F.avg(F.col("value").cast("double")).alias("value")).limit(CELLS + 1).collect()
        materials = sorted({(str(r["group"]), str(r["material"])) for r in cells})
        if len(materials) > MATERIALS or len(cells) > CELLS:
            raise ValueError(f"D is a table of columns: at most {MATERIALS} materials and {CELLS} cells")
        properties = sorted({(str(r["group"]), str(r["property"])) for r in cells})
        row, column = ({k: i for i, k in enumerate(x)} for x in (materials, properties))
        held = np.full((len(materials), len(properties)), np.nan)
        for r in cells:
            if r["value"] is not None:
                held[row[str(r["group"]), str(r["material"])], column[str(r["group"]), str(r["property"])]] = r["value"]
        z_names = [c for c in z.columns if c != lot] if z is not None else []
        model = cls(materials, properties, z_names, [c for c in y.columns if c != lot], absent, {})
        rows = written(model.assembled(f, z, y, lot))
        stats = rows.agg(F.count(F.lit(1)), *(g(c) for c in (*model.z, *model.y) for g in (F.avg, F.stddev_samp))).first()
        model.n = stats[0]
        wide = np.array([np.nan if v is None else v for v in stats[1:]], float).reshape(-1, 2)
        k = len(model.z)
        model.scales = {"F": model._material_scales(rows), "Z": usable(*wide[:k].T), "Y": usable(*wide[k:].T)}
        model._fit(rows, held, components, most, tolerance)
        return model

    def assembled(self, f: DataFrame, z: DataFrame | None, y: DataFrame | None, lot: str) -> DataFrame:
        """One row a lot: its material numbers and amounts, conditions and qualities; materials that D does not know are an error."""
        index = f.sparkSession.createDataFrame([(*m, i) for i, m in enumerate(self.materials)], "group string, material string, _at int")
        cells = f.select(F.col(lot).alias("lot"), F.col("group").cast("string").alias("group"), F.col("material").cast("string").alias("material"), F.col("value").cast("double").alias("value")).filter("value IS NOT NULL")
        cells = cells.join(F.broadcast(index), ["group", "material"], "left").withColumn("_at", F.coalesce("_at", F.raise_error(F.lit("a material without properties")).cast("int")))
        rows = cells.groupBy("lot", "_at").agg(F.sum("value").alias("value")).groupBy("lot").agg(F.collect_list(F.struct("_at", "value")).alias("cells"))
        rows = rows.select("lot", F.col("cells._at").alias("at"), F.col("cells.value").alias("value"))
        for table, names in ((z, self.z), (y, self.y)):
            if table is not None and names:
                rows = rows.join(table.select(F.col(lot).alias("lot"), *(F.col(c).cast("double").alias(c) for c in names)), "lot")
        return rows

    def _material_scales(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        m = len(self.materials)
        mean, sd, count = np.zeros(m), np.full(m, np.nan), np.zeros(m)
        for r in rows.select(F.explode(F.arrays_zip("at", "value")).alias("c")).groupBy("c.at").agg(F.count(F.lit(1)).alias("n"), F.avg("c.value").alias("mean"), F.stddev_samp("c.value").alias("sd")).collect():
            mean[r["at"]], sd[r["at"]], count[r["at"]] = r["mean"], r["sd"] if r["sd"] is not None else np.nan, r["n"]
        if self.absent == "zero" and self.n > 1:  # lots without the material have none of it
            own = np.nan_to_num(sd) ** 2 * np.maximum(count - 1, 0) + count * mean**2
            mean = mean * count / self.n
            sd = np.sqrt(np.maximum(own - self.n * mean**2, 0) / (self.n - 1))
        return usable(mean, sd)

    def _totals(self, rows: DataFrame, make) -> dict[int, np.ndarray]:
        """Sums over lots of make(lots, whose found components are taken off): vectors by number, added in tasks and then by entry."""
        model = TPLS(self.materials, self.properties, self.z, self.y, self.absent, self.scales, list(self.found))
        names = ["at", "value", *self.z, *self.y]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                x = Lots(b, model)
                for key, v in make(x, [c.take(x) for c in model.found]).items():
                    sums[key] = sums[key] + v if key in sums else v
            for key, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), key)), pa.array(np.arange(len(v))), pa.array(v)], ["key", "at", "v"])

        out: dict[int, dict[int, float]] = {}
        for r in rows.select(*names).mapInArrow(run, "key long, at long, v double").groupBy("key", "at").agg(F.sum("v").alias("v")).collect():
            out.setdefault(r["key"], {})[r["at"]] = r["v"]
        return {key: np.array([v[i] for i in range(len(v))]) for key, v in out.items()}

    def _fit(self, rows: DataFrame, held: np.ndarray, components: int, most: int, tolerance: float) -> None:
        groups = sorted({g for g, _ in self.properties})
        side = lambda names, g: np.flatnonzero([n == g for n, _ in names])
        at = {g: (side(self.materials, g), side(self.properties, g)) for g in groups}
        d, known = np.zeros_like(held), np.zeros_like(held)
        for i, j in at.values():
            own = held[np.ix_(i, j)]
            n = np.maximum((~np.isnan(own)).sum(0), 1)
            mean = np.nansum(own, 0) / n
            sd = np.sqrt(np.nansum((own - mean) ** 2, 0) / np.maximum(n - 1, 1)) if len(own) > 1 else np.ones(len(j))
            d[np.ix_(i, j)], known[np.ix_(i, j)] = scaled(own, *usable(mean, sd))
            d[np.ix_(i, j)] /= math.sqrt(own.size)  # each block weighs the same, however many materials and properties
        first = (d**2).sum(0)
        left_d = [first]
        m, kz, ky = len(self.materials), len(self.z), len(self.y)
        for _ in range(components):
            q = np.eye(ky)[0]
            for turn in range(1, most + 1):
                sums = self._totals(rows, lambda x, _, q=q: {0: sums_on(on_rows(x.y, x.y_known, q), x)})[0].reshape(2, -1)
                slope = ratio(*sums)
                h, w = slope[:m], slope[m:]
                s = ratio(d.T @ h, known.T @ h**2)
                s = s / max(np.linalg.norm(s), 1e-300)
                r = ratio(d @ s, known @ s**2)
                w = w / max(np.linalg.norm(w), 1e-300)
                trial = Component(r, w, np.zeros(0), q, s, iterations=turn)
                moments = self._totals(rows, lambda x, _, trial=trial: by_pattern(trial.blocks(x), x))
                new, weights = inner(moments, 1 + (kz > 0), ky, tolerance)
                moved = np.linalg.norm(direction(new) - direction(q)) / max(np.linalg.norm(direction(q)), 1e-300)
                q = new
                if moved < tolerance:
                    break
            sign = -1.0 if q[np.abs(q).argmax()] < 0 else 1.0
            own = Component(r, w, sign * weights, sign * q, s, iterations=turn)
            sums = self._totals(rows, lambda x, _, own=own: {0: sums_on(own.blocks(x) @ own.super, x)})[0].reshape(2, -1)
            own.p, own.pz = np.split(ratio(*sums), [m])
            own.v = np.zeros(len(self.properties))
            for i, j in at.values():
                own.v[j] = ratio(d[np.ix_(i, j)].T @ r[i], known[np.ix_(i, j)].T @ r[i] ** 2)
                d[np.ix_(i, j)] -= np.outer(r[i], own.v[j]) * known[np.ix_(i, j)]
            left_d.append((d**2).sum(0))
            self.found.append(own)
        parts = self._left(rows)
        self.score_scale = np.sqrt(parts.pop("t") / max(self.n, 1))
        parts["D"] = np.array(left_d)
        self.r2 = {k: -np.diff(v, axis=0) / np.where(v[0] > 0, v[0], np.nan) for k, v in parts.items()}

    def _left(self, rows: DataFrame) -> dict[str, np.ndarray]:
        """Sums of squares of F, Z and Y by column after 0, 1, .. components, and of the scores; one pass."""
        found, self.found = self.found, []
        try:

            def make(x: Lots, _: list) -> dict[int, np.ndarray]:
                out, scores = [], []
                for c in [None, *found]:
                    if c is not None:
                        scores.append((c.take(x) ** 2).sum())
                    out.append(np.concatenate([(v**2).sum(0) for v in (x.f, x.z, x.y)]))
                return {0: np.concatenate([*out, scores])}

            total = self._totals(rows, make)[0]
        finally:
            self.found = found
        m, kz, ky = len(self.materials), len(self.z), len(self.y)
        each = total[: (len(found) + 1) * (m + kz + ky)].reshape(len(found) + 1, -1)
        return {"F": each[:, :m], "Z": each[:, m : m + kz], "Y": each[:, m + kz :], "t": total[each.size :]}

    @property
    def components(self) -> int:
        return len(self.found)

    def t2_limit(self, conflevel: float = 0.95) -> float:
        return t2_limit(self.n, self.components, conflevel)

    def vip(self, block: str = "D", method: str = "vip") -> dict[tuple[str, str], float]:
        """Importance of each property (D) or material (F) over all components; "deflated" uses the weights of the columns as they were."""
        stack = lambda name: np.stack([getattr(c, name) for c in self.found], 1)
        names = self.properties if block == "D" else self.materials
        weights = stack("s" if block == "D" else "p")
        if method == "deflated":
            weights = weights @ np.linalg.pinv((stack("v") if block == "D" else weights).T @ weights)
        groups = np.array([g for g, _ in names])
        r2 = np.mean([np.nanmean(self.r2[block][:, groups == g], axis=1) for g in sorted(set(groups))], axis=0)
        return dict(zip(names, np.sqrt(len(names) * (weights**2 * r2).sum(1) / r2.sum()).tolist(), strict=True))

    def diagnose(self, f: DataFrame, z: DataFrame | None = None, lot: str = "lot") -> DataFrame:
        """lot, scores t1.., hotellings_t2, spe_f, spe_z and the predicted qualities of new or old lots; lots are joined by key, then mapped."""
        rows, model, k = self.assembled(f, z, None, lot), self, self.components
        names = [*(f"t{a + 1}" for a in range(k)), "hotellings_t2", "spe_f", "spe_z", *(f"{c}_hat" for c in self.y)]
        q = np.stack([c.q for c in self.found], 1) if k else np.zeros((len(self.y), 0))
        center, scale = self.scales["Y"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = Lots(b, model)
                t = np.stack([c.take(x) for c in model.found], 1) if k else np.zeros((b.num_rows, 0))
                out = np.column_stack([t, ((t / model.score_scale) ** 2).sum(1), np.sqrt((x.f**2).sum(1)), np.sqrt((x.z**2).sum(1)), t @ q.T * np.nan_to_num(scale) + center])
                yield pa.RecordBatch.from_arrays([b.column("lot"), *(pa.array(np.ascontiguousarray(v)) for v in out.T)], ["lot", *names])

        return rows.mapInArrow(run, StructType([rows.schema["lot"], *(StructField(n, DoubleType()) for n in names)]))

    def score(self, f: DataFrame, z: DataFrame | None, y: DataFrame, lot: str = "lot") -> float:
        """The mean over qualities of the share of their variation that is predicted; one aggregate."""
        rows = self.diagnose(f, z, lot).join(y.select(F.col(lot).alias("lot"), *self.y), "lot")
        row = rows.agg(*(g for c in self.y for g in (F.sum((F.col(c) - F.col(f"{c}_hat")) ** 2), F.var_pop(c) * F.count(c)))).first()
        return float(np.mean([1 - a / b if b else math.nan for a, b in zip(row[::2], row[1::2], strict=True)]))


def usable(mean: Sequence[float], sd: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Means and scales; a column without variance has no scale, and so counts as zeros."""
    mean, sd = np.nan_to_num(np.asarray(mean, float)), np.asarray(sd, float)
    return mean, np.where(sd >= TOLERANCE, sd, np.nan)


def direction(q: np.ndarray) -> np.ndarray:
    return q / max(float(q @ q), 1e-300)


def sums_on(u: np.ndarray, x: Lots) -> np.ndarray:
    """Products of the columns of F and Z with a column of lots, and its squares where they are known."""
    return np.concatenate([x.f.T @ u, x.z.T @ u, x.f_known.T @ u**2, x.z_known.T @ u**2])


def by_pattern(t: np.ndarray, x: Lots) -> dict[int, np.ndarray]:
    """t't and t'y of the lots of each pattern of known qualities, whose number is the pattern's bits."""
    pattern = (x.y_known.astype(np.int64) << np.arange(x.y.shape[1])).sum(1)
    out = {}
    for p in np.unique(pattern):
        own = pattern == p
        out[int(p)] = np.concatenate([(t[own].T @ t[own]).ravel(), (t[own].T @ x.y[own]).ravel()])
    return out


def inner(moments: dict[int, np.ndarray], blocks: int, qualities: int, tolerance: float, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """q and the super weights of one component of Y on the block scores, from their moments by pattern."""
    known = np.array([[p >> k & 1 for k in range(qualities)] for p in moments], float)
    tt = np.array([v[: blocks * blocks].reshape(blocks, blocks) for v in moments.values()])
    ty = np.array([v[blocks * blocks :].reshape(blocks, qualities) for v in moments.values()])
    q = np.eye(qualities)[0]
    for _ in range(most):
        w = np.einsum("pbk,k,p->b", ty, q, ratio(np.ones(len(known)), known @ q**2))
        w = w / max(np.linalg.norm(w), 1e-300)
        new = ratio(np.einsum("pbk,b->k", ty, w), np.einsum("pk,pbc,b,c->k", known, tt, w, w))
        moved = np.linalg.norm(direction(new) - direction(q)) / max(np.linalg.norm(direction(q)), 1e-300)
        q = new
        if moved < tolerance:
            break
    return q, w
