"""Containers of fixed capacity filled with documents: hierarchical multi-length packing.

A document belongs to the smallest tier it fits; one that exceeds every capacity is split into full
pieces of the largest and a rest. Tiers are packed from the longest by best fit decreasing, and what
room is left in a tier's containers is filled from shorter tiers before those are packed. Containers
of a tier are dealt to step groups of one token budget so that the groups are equally full. Items
are dealt to shards of bounded size by hash, each packed by itself: a shard has tens of thousands of
items, so what its last containers leave open is negligible.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 50_000
STEP_TOKENS = 65_536


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Container of each item (given in decreasing size) and the room left in each container.

    The room of open containers is a bit set, so the tightest fit is found in one step.
    """
    where = np.empty(len(sizes), dtype=np.int64)
    room: list[int] = []
    open_by: dict[int, list[int]] = {}
    mask = 0
    for i, s in enumerate(sizes.tolist()):
        m = mask >> s
        if m:
            r = s + (m & -m).bit_length() - 1
            c = open_by[r].pop()
            if not open_by[r]:
                mask &= ~(1 << r)
            left = r - s
        else:
            c, left = len(room), capacity - s
            room.append(left)
        room[c] = left
        where[i] = c
        if left:
            open_by.setdefault(left, []).append(c)
            mask |= 1 << left
    return where, room


def fill_gaps(room: list[int], pool: dict[int, list[int]]) -> list[tuple[int, int]]:
    """(item, container) for items of ``pool`` (size -> items) put into the room left, largest first.

    ``room`` and ``pool`` are changed. Containers with the most room are filled first.
    """
    out = []
    mask = 0
    for s, items in pool.items():
        mask |= (1 << s) if items else 0
    for c in sorted(range(len(room)), key=lambda c: -room[c]):
        while room[c] and mask:
            fits = mask & ((1 << (room[c] + 1)) - 1)
            if not fits:
                break
            s = fits.bit_length() - 1
            out.append((pool[s].pop(), c))
            room[c] -= s
            if not pool[s]:
                mask &= ~(1 << s)
    return out


def pack_shard(sizes: np.ndarray, capacities: list[int], step_tokens: int = STEP_TOKENS) -> list[tuple[int, int, int, int]]:
    """(item, tier, container, step group) of every item; ``capacities`` increase, sizes fit the last."""
    tier = np.searchsorted(np.array(capacities), sizes)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    left = [[int(i) for i in order if tier[i] == t] for t in range(len(capacities))]
    out = []
    for t in range(len(capacities) - 1, -1, -1):
        items = left[t]
        where, room = best_fit(sizes[items], capacities[t]) if items else (np.zeros(0, dtype=np.int64), [])
        placed = list(zip(items, where.tolist()))
        for shorter in range(t - 1, -1, -1):
            pool: dict[int, list[int]] = {}
            for i in reversed(left[shorter]):
                pool.setdefault(int(sizes[i]), []).append(i)
            gone = fill_gaps(room, pool)
            placed += gone
            taken = {i for i, _ in gone}
            left[shorter] = [i for i in left[shorter] if i not in taken]
        per = max(1, step_tokens // capacities[t])
        groups = -(-len(room) // per) if room else 0
        group = np.zeros(len(room), dtype=np.int64)
        for rank, c in enumerate(sorted(range(len(room)), key=lambda c: (room[c], c))):  # fullest first, to and fro
            lap, at = divmod(rank, groups)
            group[c] = at if lap % 2 == 0 else groups - 1 - at
        out += [(i, t, c, int(group[c])) for i, c in placed]
    return out


def pack(sizes: DataFrame, tiers: list[tuple[str, int]], shard: int = SHARD, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The container of every document or piece.

    ``sizes`` has distinct doc_id with n_tokens; ``tiers`` names and capacities (one tier is plain
    best fit). Gives doc_id, piece_no, n_tokens, container_kind, container_id, step_group. Documents
    without tokens need no room: they come out with null containers. No document is left out or
    split unless it exceeds the largest capacity. Tiers of null or non-positive capacity are ignored.
    """
    use = sorted({(c, k) for k, c in tiers if c and c > 0})
    if not use:
        raise ValueError("no container with a positive capacity")
    caps, kinds = [c for c, _ in use], [k for _, k in use]
    top = caps[-1]
    s = sizes.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
    none = s.where("n_tokens <= 0").select("doc_id", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("container_kind"), F.lit(None).cast("string").alias("container_id"), F.lit(None).cast("string").alias("step_group"))
    pieces = s.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n_tokens") / top).cast("int"))).alias("piece_no"))
    pieces = pieces.select("doc_id", "piece_no", F.least(F.lit(top), F.col("n_tokens") - (F.col("piece_no") - 1) * top).cast("long").alias("n_tokens"))
    shards = max(1, -(-pieces.count() // shard))
    kind = dict(sizes.dtypes)["doc_id"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        got = pack_shard(pdf["n_tokens"].to_numpy(), caps, step_tokens)
        item, tier, box, group = (np.array(x) for x in zip(*got))
        out = pdf.iloc[item][["doc_id", "piece_no", "n_tokens"]].reset_index(drop=True)
        at = int(pdf["shard"].iloc[0])
        out["container_kind"] = [kinds[t] for t in tier]
        out["container_id"] = [f"{kinds[t]}-{at}-{b}" for t, b in zip(tier, box)]
        out["step_group"] = [f"{kinds[t]}-{at}-{g}" for t, g in zip(tier, group)]
        return out

    packed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards))).groupBy("shard").applyInPandas(
        one, f"doc_id {kind}, piece_no int, n_tokens long, container_kind string, container_id string, step_group string"
    )
    return packed.unionByName(none)


def containers(packed: DataFrame, tiers: list[tuple[str, int]]) -> DataFrame:
    """Every container with what it holds and the room it leaves."""
    cap = F.create_map(*[x for k, c in tiers for x in (F.lit(k), F.lit(int(c)))])
    g = packed.where("container_id is not null").groupBy("container_kind", "container_id", "step_group").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used_tokens"))
    return g.withColumn("capacity_tokens", cap[F.col("container_kind")]).withColumn("unused_tokens", F.col("capacity_tokens") - F.col("used_tokens"))
