"""Stabilisation of poles over model orders: soft criteria, masks, clearing, clustering, selection."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.modal import mac, mean_phase, mpc, mpd, relative
from tremor.operators.quantiles import quantiles
from tremor.scratch import written


def pole_pairs(poles: DataFrame) -> DataFrame:
    """setup, ord, idx, prev_idx and differences of every pole to those of the previous non-empty order."""
    orders = poles.select("setup", "ord").distinct().withColumn("prev", F.lag("ord").over(Window.partitionBy("setup").orderBy("ord")))
    re, im = F.col("phi_re"), F.col("phi_im")
    told = poles.withColumns({"mpd": mpd(re, im), "mp": mean_phase(re, im)})
    cur = told.join(orders, ["setup", "ord"]).alias("c")
    pre = told.alias("p")
    both = cur.join(pre, (F.col("c.setup") == F.col("p.setup")) & (F.col("c.prev") == F.col("p.ord")))
    c, p = (lambda k: F.col(f"c.{k}")), (lambda k: F.col(f"p.{k}"))
    apart = F.sqrt(F.pow(c("lam_re") - p("lam_re"), 2) + F.pow(c("lam_im") - p("lam_im"), 2))
    larger = F.greatest(F.sqrt(F.pow(c("lam_re"), 2) + F.pow(c("lam_im"), 2)), F.sqrt(F.pow(p("lam_re"), 2) + F.pow(p("lam_im"), 2)))
    return both.select(
        c("setup").alias("setup"), c("ord").alias("ord"), c("idx").alias("idx"), p("ord").alias("prev_ord"), p("idx").alias("prev_idx"),
        (apart / larger).alias("d_lambda"), relative(c("f"), p("f")).alias("d_f"), relative(c("d"), p("d")).alias("d_d"),
        (1 - mac(c("phi_re"), c("phi_im"), p("phi_re"), p("phi_im"))).alias("d_mac"),
        F.coalesce(relative(c("mpd"), p("mpd")), F.lit(0.0)).alias("d_mpd"), F.coalesce(relative(c("mp"), p("mp")), F.lit(0.0)).alias("d_mp"),
    )


def masks(
    poles: DataFrame, df_max: float = 0.01, dd_max: float = 0.05, dmac_max: float = 0.02, d_range: tuple[float, float] = (0.0, 100.0), mpc_min: float = 0.0, mpd_max: float = 90.0,
    orders: tuple[int, int | None, int] = (0, None, 1), std_f_max: float = 100.0, std_d_max: float = 100.0, mc_min: float = 0.0,
) -> DataFrame:
    """setup, ord, idx, in_range, stable and only_f, only_d, only_mac: unstable in that criterion alone.

    The same previous pole has to meet all relative criteria; a difference of exactly 0 does not count.
    ``orders``: first, end (not in it; None: no end) and step of the orders looked at.  Where ``poles`` has std_f, std_d (bounds in per cent of
    f and d) or mc (modal contribution), they are looked at too."""
    ok = lambda name, most: (F.col(name) > 0) & (F.col(name) <= most)
    f, d, m = ok("d_f", df_max), ok("d_d", dd_max), ok("d_mac", dmac_max)
    met = pole_pairs(poles).groupBy("setup", "ord", "idx").agg(
        F.bool_or(f & d & m).alias("all3"), F.bool_or(f).alias("any_f"), F.bool_or(d).alias("any_d"), F.bool_or(m).alias("any_m")
    )
    inside = F.col("d").between(*d_range) & (mpc(F.col("phi_re"), F.col("phi_im")) >= mpc_min) & (mpd(F.col("phi_re"), F.col("phi_im")) <= mpd_max) & (F.col("f") > 0)
    first, end, step = orders
    inside = inside & (F.col("ord") >= first) & ((F.col("ord") - first) % step == 0) & (F.lit(True) if end is None else F.col("ord") < end)
    for name, keep in (("std_f", F.col("std_f") <= std_f_max / 100 * F.col("f")), ("std_d", F.col("std_d") <= std_d_max / 100 * F.col("d")), ("mc", F.abs("mc") >= mc_min)):
        if name in poles.columns:
            inside = inside & F.coalesce(keep, F.lit(True))
    no = F.lit(False)
    j = poles.select("setup", "ord", "idx", inside.alias("in_range")).join(met, ["setup", "ord", "idx"], "left")
    a, x, y, z = (F.coalesce(F.col(k), no) for k in ("all3", "any_f", "any_d", "any_m"))
    r = F.col("in_range")
    return j.select("setup", "ord", "idx", "in_range", (r & a).alias("stable"), (r & ~x & y & z).alias("only_f"), (r & x & ~y & z).alias("only_d"), (r & x & y & ~z).alias("only_mac"))


def histogram(pairs: DataFrame, column: str, bins: int, most: float) -> DataFrame:
    """bin, n: the least difference of every pole, counted in equal bins below ``most``."""
    least = pairs.groupBy("setup", "ord", "idx").agg(F.min(column).alias("x")).where(F.col("x") < most)
    return least.groupBy(F.floor(F.col("x") * bins / most).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


FEATURES = ("d_lambda", "d_f", "d_d", "d_mac", "d_mp")


def clearing(poles: DataFrame, rounds: int = 100) -> DataFrame:
    """setup, ord, idx, d_lambda, d_mac of the physical poles: 2-means on standardised logs of the least differences, each setup by itself.

    Orders 0 and 1 are left out.  The centres start at minus and plus one deviation; a round is one aggregation of two rows
    per setup, all setups together, until no centre moves."""
    least = pole_pairs(poles).where("d_f > 0 AND ord > 1").groupBy("setup", "ord", "idx").agg(*[F.min(n).alias(n) for n in FEATURES])
    logs = least.select("setup", "ord", "idx", "d_lambda", "d_mac", *[F.log(F.greatest(F.col(n), F.lit(1e-12))).alias(f"l_{n}") for n in FEATURES])
    stats = logs.groupBy("setup").agg(*[F.avg(f"l_{n}").alias(f"m_{n}") for n in FEATURES], *[F.stddev_pop(f"l_{n}").alias(f"s_{n}") for n in FEATURES])
    z = logs.join(F.broadcast(stats), "setup").select("setup", "ord", "idx", "d_lambda", "d_mac", *[((F.col(f"l_{n}") - F.col(f"m_{n}")) / F.coalesce(F.nullif(f"s_{n}", F.lit(0.0)), F.lit(1.0))).alias(f"z_{n}") for n in FEATURES])
    z = written(z, "standardised")  # every round reads it; the poles' lineage runs once
    kinds = "setup string, " + ", ".join(f"{side}_{n} double" for side in "ab" for n in FEATURES)
    centres = {r["setup"]: [-1.0] * len(FEATURES) + [1.0] * len(FEATURES) for r in z.select("setup").distinct().collect()}  # ten numbers per setup

    def assigned() -> DataFrame:
        table = z.sparkSession.createDataFrame([(k, *v) for k, v in centres.items()], kinds)
        away = lambda side: sum((F.col(f"z_{n}") - F.col(f"{side}_{n}")) ** 2 for n in FEATURES)
        return z.join(F.broadcast(table), "setup").withColumn("low", away("a") <= away("b"))

    for _ in range(rounds):
        moved = {k: list(v) for k, v in centres.items()}
        for r in assigned().groupBy("setup", "low").agg(*[F.avg(f"z_{n}").alias(n) for n in FEATURES]).collect():
            at = 0 if r["low"] else len(FEATURES)
            moved[r["setup"]][at : at + len(FEATURES)] = [r[n] for n in FEATURES]
        done = all(np.allclose(moved[k], centres[k], atol=1e-12) for k in centres)
        centres = moved
        if done:
            break
    else:
        raise ArithmeticError(f"2-means has not settled in {rounds} rounds")
    return assigned().where("low").select("setup", "ord", "idx", "d_lambda", "d_mac")


def average_linkage(d: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers by average linkage, merged up to the distance ``cut`` (nearest-neighbour chain)."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        b = int(np.argmin(np.where(alive, d[a], np.inf)))
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
            chain = chain[:-2]
            merges.append((d[a, b], a, b))
            d[a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[:, a] = d[a]
            d[a, a] = np.inf
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(b)
    for height, a, b in sorted(merges, key=lambda m: m[0]):
        if height <= cut:
            label[label == label[b]] = label[a]
    return np.unique(label, return_inverse=True)[1]


def cells(poles: DataFrame) -> DataFrame:
    """setup, a, b, part: squares of the complex plane that hold eigenvalues of a setup, numbered by connected part (neighbours touch at sides or corners).

    ``poles`` has setup, lam_re, lam_im and width, the side of the squares of the setup.  Two eigenvalues nearer than the width lie in the same
    part.  A setup has no more squares than the unit disc, whatever the number of its poles."""
    held = poles.select("setup", F.floor(F.col("lam_re") / F.col("width")).alias("a"), F.floor(F.col("lam_im") / F.col("width")).alias("b")).distinct()

    def number(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part: dict[tuple[int, int], int] = dict.fromkeys(zip(pdf["a"], pdf["b"]), -1)
        for n, start in enumerate(part):
            if part[start] >= 0:
                continue
            part[start], open_ = n, [start]
            while open_:
                a, b = open_.pop()
                for near in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if part.get(near) == -1:
                        part[near] = n
                        open_.append(near)
        return pd.DataFrame({"setup": key[0], "a": [k[0] for k in part], "b": [k[1] for k in part], "part": list(part.values())})

    return held.groupBy("setup").applyInPandas(number, "setup string, a long, b long, part int")


def separate(rows: Callable[[np.ndarray], np.ndarray], n: int, cut: float) -> list[np.ndarray]:
    """Members of the connected parts of the graph of distances up to ``cut``; ``rows(members)`` gives distances of some members to all n."""
    left, out = np.ones(n, bool), []
    while left.any():
        new = np.flatnonzero(left)[:1]
        left[new] = False
        part = [new]
        while len(new):
            near = np.zeros(n, bool)
            for i in range(0, len(new), 256):
                near |= (rows(new[i : i + 256]) <= cut).any(0)
            new = np.flatnonzero(near & left)
            left[new] = False
            part.append(new)
        out.append(np.sort(np.concatenate(part)))
    return out


def clusters(poles: DataFrame, cleared: DataFrame, cut: float | None = None) -> DataFrame:
    """setup, ord, idx, f, d, cluster of the cleared poles; distance is that of eigenvalues plus 1 - MAC.

    Without ``cut``, it is the 95th percentile of the distances of a setup's cleared poles to the order before.  Average linkage up to the cut never joins
    poles of two parts that are everywhere farther apart than the cut, so a setup is dealt to parts of the complex plane as wide as the cut, these are
    split along the distances themselves, and only what hangs together is linked.  Clusters are numbered by their first pole."""
    chosen = poles.join(cleared.select("setup", "ord", "idx"), ["setup", "ord", "idx"])
    if cut is None:
        cuts = quantiles(cleared.select("setup", (F.col("d_lambda") + F.col("d_mac")).alias("far")), ["setup"], "far", [0.95]).withColumnRenamed("q0", "cut")
    else:
        cuts = cleared.select("setup").distinct().withColumn("cut", F.lit(float(cut)))
    sizes = chosen.groupBy("setup").agg(F.max(F.sqrt(F.col("lam_re") ** 2 + F.col("lam_im") ** 2)).alias("size"))
    wide = F.greatest(F.col("cut") * F.col("size") * (1 + 1e-9), F.lit(1e-9)).alias("width")
    ready = written(chosen.join(cuts.join(sizes, "setup").select("setup", "cut", wide), "setup"), "poles")
    placed = ready.withColumns({"a": F.floor(F.col("lam_re") / F.col("width")), "b": F.floor(F.col("lam_im") / F.col("width"))}).join(cells(ready), ["setup", "a", "b"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "idx"]).reset_index(drop=True)
        lam = pdf["lam_re"].to_numpy() + 1j * pdf["lam_im"].to_numpy()
        phi = np.vstack(pdf["phi_re"]) + 1j * np.vstack(pdf["phi_im"])
        phi = phi / np.linalg.norm(phi, axis=1, keepdims=True)

        def far(m: np.ndarray, of: np.ndarray | slice = slice(None)) -> np.ndarray:
            return abs(lam[m, None] - lam[of]) / np.maximum(abs(lam[m])[:, None], abs(lam[of])) + 1 - abs(phi[m] @ phi[of].conj().T) ** 2

        limit, first_ord, first_idx = float(pdf["cut"].iloc[0]), np.zeros(len(pdf), np.int32), np.zeros(len(pdf), np.int32)
        for members in separate(far, len(pdf), limit):
            found = average_linkage(far(members, members), limit)
            for c in range(found.max() + 1):
                own = members[found == c]
                first_ord[own], first_idx[own] = pdf["ord"].iloc[own[0]], pdf["idx"].iloc[own[0]]
        return pdf.assign(first_ord=first_ord, first_idx=first_idx)[["setup", "ord", "idx", "f", "d", "first_ord", "first_idx"]]

    found = written(placed.groupBy("setup", "part").applyInPandas(run, "setup string, ord int, idx int, f double, d double, first_ord int, first_idx int"), "linked")
    first = ["first_ord", "first_idx"]
    numbers = found.select("setup", *first).distinct().withColumn("cluster", F.row_number().over(Window.partitionBy("setup").orderBy(*first)) - 1)
    return found.join(numbers, ["setup", *first]).select("setup", "ord", "idx", "f", "d", "cluster")


def selected_clusters(clustered: DataFrame, number: int = 0, rounds: int = 100) -> DataFrame:
    """setup, cluster, n of the ``number`` largest clusters of every setup; 0: of the larger side of a 2-means split of the sizes.

    The split starts at the largest size and at 0; only the counts of sizes are looked at."""
    sizes = clustered.groupBy("setup", "cluster").agg(F.count(F.lit(1)).alias("n"))
    if number:
        return sizes.withColumn("place", F.row_number().over(Window.partitionBy("setup").orderBy(F.desc("n"), "cluster"))).where(F.col("place") <= number).drop("place")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        high, low = float(pdf["n"].max()), 0.0
        for _ in range(rounds):
            large = (pdf["n"] - high).abs() <= (pdf["n"] - low).abs()
            one = (pdf["n"] * pdf["count"])[large].sum() / pdf["count"][large].sum()
            two = (pdf["n"] * pdf["count"])[~large].sum() / pdf["count"][~large].sum() if (~large).any() else low
            if (one, two) == (high, low):
                break
            high, low = one, two
        return pd.DataFrame({"setup": [pdf["setup"].iloc[0]], "least": [int(pdf["n"][large].min())]})

    least = sizes.groupBy("setup", "n").count().groupBy("setup").applyInPandas(split, "setup string, least long")
    return sizes.join(least, "setup").where("n >= least").select("setup", "cluster", "n")


def representatives(clustered: DataFrame, number: int = 0) -> DataFrame:
    """setup, cluster, n, ord, idx, f, d: the multivariate median of each selected cluster."""
    top = selected_clusters(clustered, number)

    def median(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["ord", "idx"])
        while len(left) > 1:
            for name in ("f", "d"):
                if len(left) > 1:
                    x = left[name]
                    drop = x.idxmax() if x.max() - x.median() >= x.median() - x.min() else x.idxmin()
                    left = left.drop(index=drop)
        return left[["setup", "cluster", "n", "ord", "idx", "f", "d"]]

    return clustered.join(top, ["setup", "cluster"]).groupBy("setup", "cluster").applyInPandas(median, "setup string, cluster int, n long, ord int, idx int, f double, d double")


def selected_histogram(pairs: DataFrame, masked: DataFrame, column: str, bins: int, most: float) -> DataFrame:
    """bin, n, n_stable: as ``histogram``, and how many of the counted poles are stable; ``masked`` as ``masks`` gives it."""
    least = pairs.groupBy("setup", "ord", "idx").agg(F.min(column).alias("x")).where(F.col("x") < most)
    both = least.join(masked.select("setup", "ord", "idx", "stable"), ["setup", "ord", "idx"], "left")
    return both.groupBy(F.floor(F.col("x") * bins / most).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("stable").alias("n_stable"))


#: Columns that ``modal_values`` gives.
VALUES = ("setup", "mode", "ord", "idx", "f", "d", "mpc", "mp", "mpd", "d_mp", "d_mpd")


def modal_values(poles: DataFrame, selection: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """setup, mode, ord, idx, f, d, mpc, mp, mpd and the least differences above 0 to the order before of the selected poles, by frequency.

    ``extra``: further values by name, as expressions over the columns of ``poles``; a name of one of these columns is refused."""
    clash = sorted(set(extra or {}) & set(VALUES))
    if clash:
        raise ValueError(f"there are values {', '.join(clash)} already")
    re, im = F.col("phi_re"), F.col("phi_im")
    chosen = poles.join(selection.select("setup", "ord", "idx"), ["setup", "ord", "idx"])
    positive = lambda n: F.min(F.when(F.col(n) > 0, F.col(n))).alias(n)
    least = pole_pairs(poles).groupBy("setup", "ord", "idx").agg(positive("d_mp"), positive("d_mpd"))
    place = F.row_number().over(Window.partitionBy("setup").orderBy("f", "ord", "idx"))
    return chosen.join(least, ["setup", "ord", "idx"], "left").select("setup", (place - 1).cast("int").alias("mode"), "ord", "idx", "f", "d", mpc(re, im).alias("mpc"), mean_phase(re, im).alias("mp"), mpd(re, im).alias("mpd"), "d_mp", "d_mpd", *(value.alias(name) for name, value in (extra or {}).items()))


def add_mode(selection: DataFrame, setup: str, order: int, idx: int) -> DataFrame:
    one = selection.sparkSession.createDataFrame([(setup, order, idx)], "setup string, ord int, idx int")
    return selection.select("setup", "ord", "idx").unionByName(one).distinct()


def remove_mode(selection: DataFrame, setup: str, order: int, idx: int) -> DataFrame:
    return selection.where(~((F.col("setup") == setup) & (F.col("ord") == order) & (F.col("idx") == idx)))


def nearest_pole(poles: DataFrame, points: DataFrame, f_span: float, ord_span: float) -> DataFrame:
    """id, setup, ord, idx: the pole nearest to each point (id, setup, f, ord) in a diagram of that width and height."""
    p, q = poles.alias("p"), F.broadcast(points).alias("q")
    far = F.pow((F.col("p.f") - F.col("q.f")) / f_span, 2) + F.pow((F.col("p.ord") - F.col("q.ord")) / ord_span, 2)
    near = p.join(q, F.col("p.setup") == F.col("q.setup")).groupBy("q.id", "q.setup").agg(F.min(F.struct(far.alias("far"), F.col("p.ord").alias("ord"), F.col("p.idx").alias("idx"))).alias("n"))
    return near.select("id", "setup", "n.ord", "n.idx")


def contributions_by_order(poles: DataFrame) -> DataFrame:
    """setup, ord, mc: magnitude of the summed modal contributions of every order; ``poles`` has mc."""
    return poles.groupBy("setup", "ord").agg(F.abs(F.sum("mc")).alias("mc"))


def student_quantile(p: float, freedom: int) -> float:
    """Quantile of Student's t for p above one half, by bisection of its distribution function (a finite sum for whole degrees of freedom)."""

    def above(t: float) -> float:
        angle = np.arctan(t / np.sqrt(freedom))
        c = np.cos(angle) ** 2
        terms, term = 0.0, 1.0
        if freedom % 2:
            for j in range(1, (freedom - 1) // 2 + 1):
                terms += term
                term *= c * 2 * j / (2 * j + 1)
            return 0.5 + (angle + np.sin(angle) * np.cos(angle) * terms) / np.pi
        for j in range(1, freedom // 2 + 1):
            terms += term
            term *= c * (2 * j - 1) / (2 * j)
        return 0.5 + np.sin(angle) * terms / 2

    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) < p else (low, mid)
    return high


def confidence(poles: DataFrame, blocks: int, level: float = 0.95) -> DataFrame:
    """``poles`` with half_f and half_d: half-widths of the confidence intervals of f and d estimated from so many blocks."""
    t = student_quantile((1 + level) / 2, blocks) / np.sqrt(blocks)
    return poles.withColumns({f"half_{n}": F.lit(float(t)) * F.col(f"std_{n}") for n in "fd"})
