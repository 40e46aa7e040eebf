"""Items of varying length put into containers of fixed capacity.

Vector bin packing: a container has simultaneous limits on tokens, on the number of items
(segments) and on loss-bearing tokens, for instruction data. A container is filled by the
item with the largest dot product of its sizes and the container's remaining room, each
dimension scaled by its limit; when nothing fits, the next container is opened.

Items are spread over groups of about ``GROUP`` by a hash of their key and packed group by
group, so a group never grows with the corpus and costs at most its last containers. Only an
item larger than the capacity is split: its full stretches fill containers of their own and
the rest is packed like any item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 8192
#: Segments a container may hold, per 1,024 tokens of capacity, and the share of its tokens that may
#: bear loss. A container opened by an item over such a limit by itself has not that limit.
SEGMENTS_PER_1024 = 16
LOSS_SHARE = 0.75

SCHEMA = "limit_id int, container string, doc_id long, piece int, start long, n_tokens long, n_loss long"


def fill(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item; ``sizes`` is (n, d), every item within ``limits[0]``.

    Deterministic: ties go to the earlier item. Items of one size are handled as one kind, so
    a step costs the number of kinds, not of items. An item over one of the other limits by
    itself opens a container without that limit, so that it can be filled all the same.
    """
    out = np.full(len(sizes), -1, dtype=np.int64)
    if not len(sizes):
        return out
    kinds, inverse = np.unique(sizes, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    order = np.argsort(inverse, kind="stable")
    left = np.bincount(inverse, minlength=len(kinds))
    next_of = np.concatenate([[0], np.cumsum(left)[:-1]])
    ids = np.arange(len(kinds))
    dims = range(sizes.shape[1])

    def live() -> tuple:
        keep = ids[left[ids] > 0]
        cols = [np.ascontiguousarray(kinds[keep, d]) for d in dims]
        return keep, cols, [c / limits[d] for d, c in enumerate(cols)], [c.max(initial=0) for c in cols], np.zeros(len(keep))

    def take(k: int) -> None:
        nonlocal remaining, dead
        kind = ids[k]
        out[order[next_of[kind]]] = box
        next_of[kind] += 1
        left[kind] -= 1
        remaining -= 1
        if not left[kind]:
            gone[k] = -10.0
            dead += 1

    ids, cols, scaled, most, gone = live()
    box, remaining, dead, first_pass = 0, len(sizes), 0, True
    while remaining:
        room = [int(x) for x in limits]
        if first_pass:
            over = (gone == 0) & np.any([cols[d] > room[d] for d in dims[1:]], axis=0)
            first_pass = bool(over.any())
        if first_pass:
            k = int(over.argmax())
            take(k)
            # the limit it is over is lifted from its container, down to what tokens are left
            room = [max(0, r - int(c[k])) if c[k] <= r else max(0, room[0] - int(cols[0][k])) for r, c in zip(room, cols)]
        while True:
            # kinds are sorted by their first size: only a stretch from the start can fit
            p = int(np.searchsorted(cols[0], room[0], side="right"))
            if not p:
                break
            score = scaled[0][:p] * (room[0] / limits[0]) + gone[:p]
            for d in dims[1:]:
                score += scaled[d][:p] * (room[d] / limits[d])
                if most[d] > room[d]:
                    score[cols[d][:p] > room[d]] = -1.0
            k = int(score.argmax())
            if score[k] < 0:
                break
            take(k)
            for d in dims:
                room[d] -= int(cols[d][k])
        box += 1
        if dead > 64 and 4 * dead > len(ids):
            ids, cols, scaled, most, gone = live()
            dead = 0
    return out


def limits_of(cap: int, loss_share: float = LOSS_SHARE, segments_per_1024: int = SEGMENTS_PER_1024) -> np.ndarray:
    """Limits of a container on tokens, loss-bearing tokens and segments."""
    return np.array([cap, max(1, int(cap * loss_share)), max(1, cap * segments_per_1024 // 1024)], dtype=np.int64)


def pack(
    items: DataFrame, capacities: list[tuple[int, int]], n_items: int, loss_share: float = LOSS_SHARE, segments_per_1024: int = SEGMENTS_PER_1024
) -> DataFrame:
    """``limit_id, container, doc_id, piece, start, n_tokens, n_loss`` for each capacity.

    ``items`` has ``doc_id, n_tokens, n_loss``; ``capacities`` lists ``(limit_id, max_tokens)``
    and is the size of the limits table; ``n_items`` sizes the groups. Every token is in
    exactly one row; items without tokens are in none. Repeated keys are separate items. The last
    ``n_loss`` tokens of an item bear loss (all, where it is null), and so do their pieces.
    """
    if not capacities:
        return items.sparkSession.createDataFrame([], SCHEMA)
    groups = max(1, -(-n_items // GROUP))
    caps = F.array(*[F.struct(F.lit(i).alias("limit_id"), F.lit(c).cast("bigint").alias("cap")) for i, c in capacities])
    each = items.where("n_tokens > 0").select("doc_id", "n_tokens", F.coalesce("n_loss", "n_tokens").alias("n_loss"), F.explode(caps).alias("c"))
    # one row a piece: full stretches of an oversized item and its rest, or the item itself
    cap = F.col("c.cap")
    pieces = F.sequence(F.lit(0), (F.ceil(F.col("n_tokens") / cap) - 1).cast("int"))
    each = each.select("c.limit_id", cap.alias("cap"), "doc_id", "n_tokens", "n_loss", F.explode(pieces).alias("piece"))
    size = F.least(F.col("n_tokens") - F.col("piece") * F.col("cap"), F.col("cap"))
    rest = each.select(
        "limit_id", "cap", "doc_id", "piece", (F.col("piece") * F.col("cap")).alias("start"), size.alias("n_tokens"),
        # the first tokens of an item bear no loss, so a piece bears what lies behind them
        F.greatest(F.lit(0).cast("bigint"), F.least(size, size - (F.col("n_tokens") - F.col("n_loss") - F.col("piece") * F.col("cap")))).alias("n_loss"),
        F.pmod(F.xxhash64("doc_id", F.when(size == F.col("cap"), F.floor(F.col("piece") / GROUP))), F.lit(groups)).alias("g"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "n_tokens"], kind="stable").reset_index(drop=True)
        cap, g = int(pdf["cap"].iloc[0]), pdf["g"].iloc[0]
        full = (pdf["n_tokens"] == cap).to_numpy()
        part = pdf[~full]
        sizes = np.stack([part["n_tokens"], part["n_loss"], np.ones(len(part), dtype=np.int64)], axis=1).astype(np.int64)
        limits = limits_of(cap, loss_share, segments_per_1024)
        box = np.empty(len(pdf), dtype=np.int64)
        box[~full] = fill(sizes, limits)
        box[full] = np.arange(full.sum()) + (box[~full].max(initial=-1) + 1)
        pdf["container"] = f"{g}-" + pd.Series(box).astype(str)
        return pdf[["limit_id", "container", "doc_id", "piece", "start", "n_tokens", "n_loss"]]

    return rest.groupBy("limit_id", "g").applyInPandas(run, SCHEMA)
