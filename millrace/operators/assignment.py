"""Work assignment: sticky balanced owners for weighted splits, and who may claim which split."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_MOVES = 4096


def tie(seed: int, member: str) -> int:
    """Orders members of equal load; it depends on the job's seed alone, so that any planner breaks ties alike."""
    return int.from_bytes(hashlib.sha256(f"{seed}\n{member}".encode()).digest()[:8], "big")


def desired_assignment(members: Collection[str], splits: dict[str, tuple[int, str | None]], reserved: Collection[str] = (), caps: dict[str, int] | None = None, default_cap: int = 512, seed: int = 0) -> dict[str, str]:
    """Owner of each split (weight, present owner). Owners that still exist keep theirs within their caps, heaviest first;
    the others go, heaviest first, to the lightest member with room; then moves that lower the sum of squared loads are
    made, best first. Reserved splits are withheld; splits beyond all caps stay unassigned. Weights and caps count as at
    least 1. Moves of equal gain: the member first in tie order gives, and of its splits the first by name goes."""
    caps = caps or {}
    names = sorted(members, key=lambda m: (tie(seed, m), m))
    load = dict.fromkeys(names, 0)
    room = {m: max(1, caps.get(m, default_cap)) for m in names}
    held: dict[str, list[tuple[int, str]]] = {m: [] for m in names}  # (weight, split), sorted
    weight = {s: max(1, w) for s, (w, _) in splits.items() if s not in reserved}
    order = sorted(weight, key=lambda s: (-weight[s], s))

    def give(s: str, m: str) -> None:
        insort(held[m], (weight[s], s))
        load[m] += weight[s]
        room[m] -= 1

    rest = []
    for s in order:
        m = splits[s][1]
        if m in load and room[m] > 0:
            give(s, m)
        else:
            rest.append(s)
    for s in rest:
        free = [m for m in names if room[m] > 0]
        if not free:
            break
        give(s, min(free, key=load.__getitem__))  # the first of the lightest: names are in tie order
    for _ in range(MAX_MOVES):
        free = sorted((m for m in names if room[m] > 0), key=load.__getitem__)[:2]  # for any giver the lightest other gains most
        best = None
        for a in names:
            b = next((m for m in free if m != a), None)
            gap = load[a] - load[b] if b is not None else 0
            at = bisect_left(held[a], (gap / 2, ""))  # 2w(gap - w) is largest next to gap / 2
            near = [held[a][bisect_left(held[a], (held[a][i][0], ""))] for i in (at - 1, at) if 0 <= i < len(held[a])]
            for w, s in near:
                gain = 2 * w * (gap - w)
                if gain > 0 and (best is None or gain > best[0] or gain == best[0] and a == best[1] and s < best[3]):
                    best = (gain, a, b, s)
        if best is None:
            break
        _, a, b, s = best
        held[a].remove((weight[s], s))
        load[a] -= weight[s]
        room[a] += 1
        give(s, b)
    return {s: m for m in names for _, s in held[m]}


def claim(status: Column, lease_owner: Column, me: Column, owner: Column, epoch: Column, attempts: Column, max_attempts: int, known: Column | bool = True) -> Column:
    """What `me` may do with a split, as struct<action, kind>; null where there is nothing to do. A split under my own lease
    is reclaimed, one under another's is left alone. Without a lease the record decides: never owned (create), given back
    (released), or left behind by an owner (expired). Reclaims and expiries use up an attempt: the one that would reach the
    limit quarantines the split. A split whose description is not yet known can't be claimed, but be quarantined."""
    kind = (
        F.when(lease_owner == me, "reclaim")
        .when(lease_owner.isNotNull(), F.lit(None).cast("string"))
        .when(owner.isNotNull(), "expired")
        .when(epoch == 0, "create")
        .otherwise("released")
    )
    last = kind.isin("reclaim", "expired") & (F.coalesce(attempts, F.lit(0)) + 1 >= max_attempts)
    known = known if isinstance(known, Column) else F.lit(known)
    action = F.when(last, "quarantine").when(known, "claim")
    return F.when((status == "runnable") & kind.isNotNull() & action.isNotNull(), F.struct(action.alias("action"), kind.alias("kind")))
