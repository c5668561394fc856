"""Sparse positive definite systems of large plants, in rounds over overlapping patches.

Unknowns are dealt into the cells of a k-d partition. A patch holds the rows of its own
unknowns and of all that these couple with. In a round each patch solves its part of the
residual roughly, its own unknowns' share of that is a direction, and directions of all patches
together are one step of conjugate gradients that keeps the last few directions conjugate, so
that the error falls in every round whatever the patches gave. What moves between tasks is the
patches' vectors; the matrix stays where it was packed, and a task holds one patch. Where every unknown is
held to a place of its own, rounds do not grow with the plant and the work grows with its points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.operators import dissection
from arborel.operators.paths import patches
from arborel.scratch import discard, materialize

#: Unknowns of a patch, directions that are kept conjugate, and how far a patch's residual falls in a round.
PATCH, KEPT, ROUGH = 8192, 4, 0.03
KEY = ["plant_id", "patch"]


def conjugate_gradients(apply, b: np.ndarray, x: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-7, most: int = 5000, enough: float | None = None, rough=None) -> np.ndarray:
    """Solve for three right-hand sides at once from the guess x, with a Jacobi preconditioner or the given one, rough(r).

    Residuals fall to `tolerance` times the right-hand side's norm. Where they do not within
    `most` rounds, or numbers stop being finite, that is an ArithmeticError; a coarser `enough`
    is for tolerances at the edge of double precision, which rounding may keep out of reach.
    """
    r = b - apply(x)
    inverse = 1 / np.where(diagonal > 0, diagonal, 1.0)[:, None]
    rough = rough or (lambda r: inverse * r)
    z = rough(r)
    p, rz = z.copy(), (r * z).sum(axis=0)
    norm = np.maximum(np.sqrt((b * b).sum(axis=0)), 1e-300)
    for _ in range(most):
        left = np.sqrt((r * r).sum(axis=0))
        if (left <= tolerance * norm).all():
            return x
        if not np.isfinite(left).all():
            break
        q = apply(p)
        alpha = rz / np.maximum((p * q).sum(axis=0), 1e-300)
        x = x + alpha * p
        r = r - alpha * q
        z = rough(r)
        new = (r * z).sum(axis=0)
        p = z + new / np.maximum(rz, 1e-300) * p
        rz = new
    r = b - apply(x)
    left = np.sqrt((r * r).sum(axis=0)) / norm
    if not (left <= (tolerance if enough is None else enough)).all():
        raise ArithmeticError(f"the system is not solved after {most} rounds: residual {left.max():.3g} of the right-hand side, wanted {tolerance:.3g}")
    return x


def product(n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray):
    """x -> A x for the n by n matrix A of entries (i, j, v), which add up; its rows are laid out once."""
    if (i[1:] < i[:-1]).any():
        order = np.argsort(i, kind="stable")
        i, j, v = i[order], j[order], v[order]
    start = np.flatnonzero(np.diff(i, prepend=-1))
    held = i[start]

    def apply(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, x.shape[1]))
        if len(start):
            for c in range(x.shape[1]):
                out[held, c] = np.add.reduceat(v * x[:, c].copy()[j], start)
        return out

    return apply


def _packed(coo: DataFrame, rhs: DataFrame, places: DataFrame, patch: int) -> DataFrame:
    """A row for each patch: its members' ids, matrix (start, cols, vals), right-hand sides and homes, and what it sends where."""
    kind = dict(rhs.dtypes)["plant_id"]
    owner = materialize(patches(places.withColumnRenamed("row", "point_id"), patch).withColumnRenamed("point_id", "row"), "schwarz-patches", merged=True)
    lines = coo.groupBy("plant_id", "row").agg(F.collect_list("col").alias("cols"), F.collect_list("val").alias("vals"))
    lines = rhs.join(lines, ["plant_id", "row"], "left").join(owner.withColumnRenamed("patch", "home"), ["plant_id", "row"])
    lines = materialize(lines, "schwarz-lines", merged=True)
    met = lines.select("plant_id", F.col("home").alias("patch"), F.explode("cols").alias("row")).unionByName(owner.select("plant_id", "patch", "row")).distinct()
    members = materialize(met.join(lines, ["plant_id", "row"]), "schwarz-members", merged=True)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        ids = pdf["row"].to_numpy()
        held = [([], []) if c is None else (c, v) for c, v in zip(pdf["cols"], pdf["vals"], strict=True)]
        i = np.repeat(np.arange(len(ids)), [len(c) for c, _ in held])
        cols, vals = np.concatenate([np.asarray(c, np.int64) for c, _ in held]), np.concatenate([np.asarray(v, float) for _, v in held])
        at = np.minimum(np.searchsorted(ids, cols), len(ids) - 1)
        inside = ids[at] == cols
        names, home = np.unique(pdf["home"].to_numpy(str), return_inverse=True)
        start = np.searchsorted(i[inside], np.arange(len(ids) + 1))
        return pd.DataFrame({
            "plant_id": [key[0]], "patch": [key[1]], "ids": [ids], "start": [start.astype(np.int32)], "cols": [at[inside].astype(np.int32)], "vals": [vals[inside]],
            "b": [np.stack(pdf["b"].to_list()).ravel()], "names": [list(names)], "home": [home.astype(np.int32)],
        })

    schema = f"plant_id {kind}, patch string, ids array<long>, start array<int>, cols array<int>, vals array<double>, b array<double>, names array<string>, home array<int>"
    packed = members.groupBy(*KEY).applyInPandas(pack, schema)
    sent = members.where("home <> patch").groupBy("plant_id", F.col("home").alias("from"), "patch").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    sent = sent.groupBy("plant_id", F.col("from").alias("patch")).agg(F.collect_list(F.struct(F.col("patch").alias("to"), "rows")).alias("out"))
    packed = materialize(packed.join(sent, KEY, "left"), "schwarz-packed")
    discard(lines, members)
    return packed


class _Patch:
    """One patch's packed row in a task, with the state it keeps from round to round."""

    def __init__(self, row: pd.Series, width: int):
        self.row, self.width = row, width
        self.ids, self.home = np.asarray(row["ids"]), np.asarray(row["home"])
        self.names = list(row["names"])
        self.own = self.home == self.names.index(row["patch"])
        self.i, self.cols, self.vals = np.repeat(np.arange(len(self.ids)), np.diff(row["start"])), np.asarray(row["cols"]), np.asarray(row["vals"])
        self.product = product(len(self.ids), self.i, self.cols, self.vals)

    def split(self, flat: np.ndarray, shapes: list[int]) -> list[np.ndarray]:
        ends = np.cumsum(np.array(shapes) * self.width)
        return [v.reshape(-1, self.width) for v in np.split(flat, ends[:-1])]

    def spread(self, own: np.ndarray, mail: pd.DataFrame) -> np.ndarray:
        """Values at all members: own ones and what other patches sent, each in the order of ids."""
        out = np.empty((len(self.ids), self.width))
        out[self.own] = own
        for sender, vals in zip(mail["sender"], mail["vals"], strict=True):
            if sender != self.row["patch"]:
                out[self.home == self.names.index(sender)] = np.asarray(vals).reshape(-1, self.width)
        return out

    def diagonal(self) -> np.ndarray:
        on = self.i == self.cols
        return np.bincount(self.i[on], self.vals[on], len(self.ids))

    def mail(self, state: list[np.ndarray], news: np.ndarray, dots: np.ndarray | None) -> pd.DataFrame:
        """The state to itself and news (at own unknowns) to the patches that hold them."""
        own, rows = self.ids[self.own], [(self.row["patch"], np.concatenate([v.ravel() for v in state]), dots)]
        for sent in [] if self.row["out"] is None else self.row["out"]:
            rows.append((sent["to"], news[np.searchsorted(own, np.asarray(sent["rows"]))].ravel(), None))
        out = pd.DataFrame(rows, columns=["patch", "vals", "dots"])
        out.insert(0, "plant_id", self.row["plant_id"])
        out["sender"] = self.row["patch"]
        return out[["plant_id", "patch", "sender", "vals", "dots"]]


def _own_state(p: _Patch, mail: pd.DataFrame) -> np.ndarray:
    return np.asarray(mail["vals"][mail["sender"] == p.row["patch"]].iloc[0], float)


def _direct(width: int, kept: int, steps: dict):
    """Take the last direction's step, then find the next: state x, r, kept (p, q).., z and news z."""

    def run(pdf: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        p = _Patch(pdf.iloc[0], width)
        n, m = len(p.ids), int(p.own.sum())
        if len(mail):
            x, r, *more = p.split(_own_state(p, mail), [m, n] + [m, n] * kept + [m, m])
            pairs, z = list(zip(more[0:-2:2], more[1:-2:2], strict=True)), more[-2]
            q = p.spread(more[-1], mail)
            beta, alpha = steps[p.row["plant_id"]]
            for (old, image), s in zip(pairs, beta, strict=True):
                z, q = z - s * old, q - s * image
            x, r = x + alpha * z, r - alpha * q
            pairs = [*pairs, (z, q)][-KEPT:]
        else:
            x, r, pairs = np.zeros((m, width)), np.asarray(p.row["b"], float).reshape(-1, width), []
        z = conjugate_gradients(p.product, r, np.zeros_like(r), p.diagonal(), ROUGH, enough=np.inf)[p.own]
        return p.mail([x, r, *[v for pair in pairs for v in pair], z], z, None)

    return run


def _multiply(width: int, kept: int):
    """The matrix times the direction: state x, r, kept (p, q).., z, q and news q, with the sums of z q_j, of z r, z q, r r and b b."""

    def run(pdf: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        p = _Patch(pdf.iloc[0], width)
        n, m = len(p.ids), int(p.own.sum())
        state = p.split(_own_state(p, mail), [m, n] + [m, n] * kept + [m])
        z, r, b = state[-1], state[1][p.own], np.asarray(p.row["b"], float).reshape(-1, width)[p.own]
        q = p.product(p.spread(z, mail))[p.own]
        both = [(z, image[p.own]) for image in state[3:-1:2]] + [(z, r), (z, q), (r, r), (b, b)]
        return p.mail([*state, q], q, np.concatenate([(u * v).sum(axis=0) for u, v in both]))

    return run


def solve(coo: DataFrame, rhs: DataFrame, places: DataFrame, patch: int = PATCH, tolerance: float = 1e-10, most: int = 200) -> DataFrame:
    """(plant_id, row, ..) of A X = B for A(plant_id, row, col, val), symmetric and positive definite.

    rhs(plant_id, row, ..) has a row for each unknown and a column for each right-hand side;
    the answer has the same columns. places(plant_id, row, x, y, z) says where unknowns lie:
    those coupled should lie near each other, or patches hold much of the plant. Entries at one
    place add up. Residuals that are not below tolerance times the right-hand side after `most`
    rounds, or numbers that are not finite, are an ArithmeticError.
    """
    spark, names = rhs.sparkSession, [c for c in rhs.columns if c not in ("plant_id", "row")]
    kind, width = dict(rhs.dtypes)["plant_id"], len(names)
    rhs = rhs.select("plant_id", F.col("row").cast("long"), F.array(*[F.col(c).cast("double") for c in names]).alias("b"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = _packed(coo, rhs, places, patch).repartition(parts, *KEY).persist()
    schema = f"plant_id {kind}, patch string, sender string, vals array<double>, dots array<double>"
    mail, steps, kept, norms = spark.createDataFrame([], schema), {}, 0, {}
    deal = lambda run, label: materialize(packed.groupBy(*KEY).cogroup(mail.groupBy(*KEY)).applyInPandas(run, schema), label)
    try:
        for rounds in range(most):
            before, mail = mail, deal(_direct(width, kept, steps), "schwarz-directions")
            discard(before)
            kept = min(rounds, KEPT)
            before, mail = mail, deal(_multiply(width, kept), "schwarz-products")
            discard(before)
            sums = mail.where("dots is not null").select("plant_id", F.posexplode("dots").alias("at", "v")).groupBy("plant_id", "at").agg(F.sum("v").alias("v")).collect()
            done = True
            for plant in {s["plant_id"] for s in sums}:
                of = np.array([s["v"] for s in sorted((s for s in sums if s["plant_id"] == plant), key=lambda s: s["at"])]).reshape(-1, width)
                *cross, zr, zq, rr, bb = of
                if not np.isfinite(of).all():
                    raise ArithmeticError(f"the system of plant {plant!r} is not solved: its numbers are not finite")
                known = norms.setdefault(plant, [])
                beta = [np.where(k > 0, c / np.where(k > 0, k, 1.0), 0.0) for c, k in zip(cross, known, strict=True)]
                size = zq - sum(s * s * k for s, k in zip(beta, known, strict=True))
                # a right-hand side whose direction vanished or turned bad rests for a round
                alpha = np.where(size > 0, zr / np.where(size > 0, size, 1.0), 0.0)
                done &= bool((rr <= tolerance**2 * bb).all())
                steps[plant] = beta, alpha
                norms[plant] = [*known, np.maximum(size, 0.0)][-KEPT:]
            if done:
                break
        else:
            raise ArithmeticError(f"the system is not solved after {most} rounds of patches")
        out = _answer(packed, mail, names, kind)
        dissection._check(coo, rhs, out.select("plant_id", "row", F.array(*names).alias("x")), width, max(tolerance, 1e-7))
        return out
    finally:
        packed.unpersist()


def _answer(packed: DataFrame, mail: DataFrame, names: list[str], kind: str) -> DataFrame:
    width = len(names)

    def run(pdf: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        p = _Patch(pdf.iloc[0], width)
        m = int(p.own.sum())
        x = _own_state(p, mail)[: m * width].reshape(-1, width)
        return pd.DataFrame({"plant_id": [p.row["plant_id"]] * m, "row": p.ids[p.own], **{c: x[:, i] for i, c in enumerate(names)}})

    found = packed.groupBy(*KEY).cogroup(mail.groupBy(*KEY)).applyInPandas(run, f"plant_id {kind}, row long, " + ", ".join(f"{c} double" for c in names))
    return materialize(found, "schwarz-solved")
