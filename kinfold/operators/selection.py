"""Sites chosen by rules that look beyond the row: greedy thinning and exact random subsets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_from(pos: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of the first position that is not below each ``at``."""
    return np.searchsorted(pos, at, "left")


def chained(pos: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """The last position that is kept if the first one kept stands at each place ``start``."""
    at = start.copy()
    while True:
        then = first_from(pos, pos[at] + distance)
        on = then < len(pos)
        if not on.any():
            return pos[at]
        at[on] = then[on]


def window_map(pos: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """What a window of ascending positions does to the last position kept before it, as steps: if
    that one is ``bounds[k]`` at most (and above the bound before), ``lasts[k]`` is the last one
    kept after it; beyond all bounds it stays as it is. Only starts that a position before the
    window can lead to are followed, and equal steps are one."""
    starts = np.arange(min(len(pos), int(first_from(pos, np.array([pos[0] + distance]))[0]) + 1))
    lasts = chained(pos, starts, distance)
    change = np.append(lasts[1:] != lasts[:-1], True)
    return (pos[starts] - distance)[change], lasts[change]


def thin(sites: DataFrame, distance: int, window: int | None = None) -> DataFrame:
    """Greedy thinning of each contig (chrom, pos): a site is kept if it is at least ``distance``
    after the last kept one; of sites at one position the first by its other columns. With a
    distance of 0 all stay. Sites without a contig or position go.

    The rule looks sequential, but a window of positions acts on what comes before it only by the
    last position kept, and that action is a short step function. So each window of the contig
    is a task that gives its function; these are composed in order, a row a window; and each window
    then keeps its sites from where it begins. No task sees a contig's sites."""
    sites = sites.where("chrom IS NOT NULL AND pos IS NOT NULL")
    if distance <= 0:
        return sites
    window = window or max(64 * distance, 1_000_000)
    rows = sites.groupBy("chrom", "pos").agg(F.min(F.struct(*sites.columns)).alias("site")).withColumn("window", F.floor(F.col("pos") / window))
    places = rows.select("chrom", "window", "pos")

    def mapped(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bounds, lasts = window_map(np.sort(pdf.pos.to_numpy()), distance)
        return pd.DataFrame({"chrom": [key[0]], "window": [key[1]], "bounds": [bounds], "lasts": [lasts]})

    def composed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        last, before = None, []
        for bounds, lasts in zip(*pdf.sort_values("window")[["bounds", "lasts"]].to_numpy().T, strict=True):
            before.append(last)
            k = 0 if last is None else int(first_from(bounds, np.array([last]))[0])
            last = int(lasts[k]) if k < len(bounds) else last
        return pd.DataFrame({"chrom": key[0], "window": np.sort(pdf.window.to_numpy()), "before": pd.array(before, "Int64")})

    def kept(key: tuple, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pos, last = np.sort(pdf.pos.to_numpy()), before.before.iloc[0] if len(before) else None
        at, out = 0 if pd.isna(last) else int(first_from(pos, np.array([last + distance]))[0]), []
        while at < len(pos):
            out.append(pos[at])
            at = int(first_from(pos, np.array([pos[at] + distance]))[0])
        return pd.DataFrame({"chrom": pd.Series([key[0]] * len(out), dtype=object), "pos": np.array(out, np.int64)})

    maps = places.groupBy("chrom", "window").applyInPandas(mapped, "chrom string, window long, bounds array<long>, lasts array<long>")
    before = maps.groupBy("chrom").applyInPandas(composed, "chrom string, window long, before long")
    stay = places.groupBy("chrom", "window").cogroup(before.groupBy("chrom", "window")).applyInPandas(kept, "chrom string, pos long")
    return rows.join(stay, ["chrom", "pos"]).select("site.*")


def random_key(columns: list[str], seed: int) -> Column:
    """60 random bits for a row, the same in each run."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def random_subset(sites: DataFrame, k: int, seed: int, bits: int = 14) -> DataFrame:
    """Exactly ``k`` rows (all, if there are fewer): those with the least random keys, of chrom and
    pos; of rows with one key any of them, by a second one.

    The cut is found by counting keys by their leading bits, then within the one range in which
    it lies by the next bits, and so on; a pass gives 2^``bits`` counts at most, and no task
    gathers the candidates of others."""
    columns = sites.columns
    second = F.xxhash64(*(F.col(c) for c in columns), F.monotonically_increasing_id()).bitwiseAND(F.lit(2**60 - 1))
    rows = sites.select(*columns, F.struct(random_key(["chrom", "pos"], seed).alias("a"), second.alias("b")).alias("_key"))
    cut: list[int] = []
    want = k
    for name in "ab":
        low, width = 0, 60
        while width > 0:
            step = min(bits, width)
            width -= step
            place = F.shiftright(F.col(f"_key.{name}") - F.lit(low), width)
            inside = (F.col(f"_key.{name}") >= low) & (F.col(f"_key.{name}") < low + (1 << (width + step)))
            part = rows.where(inside if name == "a" else inside & (F.col("_key.a") == cut[0]))
            counts = sorted((r["p"], r["n"]) for r in part.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect())
            for p, n in counts:
                if n > want:
                    break
                want -= n
            else:  # only where there are no more than k rows in all
                return sites
            low += p << width
            if want == 0:  # the rest of the range is not needed
                below = F.col(f"_key.{name}") < low
                whole = below if name == "a" else (F.col("_key.a") < cut[0]) | (F.col("_key.a") == cut[0]) & below
                return rows.where(whole).select(*columns)
        cut.append(low)
    # equal in both keys: rows alike in all that counts, of which want are missing
    same = rows.where((F.col("_key.a") == cut[0]) & (F.col("_key.b") == cut[1])).limit(want)
    return rows.where((F.col("_key.a") < cut[0]) | (F.col("_key.a") == cut[0]) & (F.col("_key.b") < cut[1])).unionByName(same).select(*columns)
