"""Filling fixed-capacity containers with items.

Items larger than the capacity are divided into full containers and a rest. The items are spread over blocks of bounded size by
hash, so each block has the mixture of sizes of the whole; in a block, bin completion works around the largest item left: it
enumerates undominated fillings of the remaining space, prunes by the waste that the incumbent still allows, and keeps the best
solution. Best-fit decreasing gives the first incumbent. Containers that stay too empty are opened and packed again in fewer
blocks, until one block is left or nothing more is gained.

Defined results: items without tokens need no place; repeated rows are items of their own; a capacity that is NULL or below 1 is
left out; empty tables give an empty result; an item of exactly the capacity has a container to itself.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.tokens import VOCABULARY, token_counts
from citeloom.session import bounded_rows, checkpointed

BLOCK_ITEMS = 4000
MAX_PACKS = 1000
FULL = 0.97  # containers below this are packed again
ROUNDS = 3

#: Sizes of a container with their numbers, greatest first.
Filling = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Effort:
    """How far a block is searched; None is without bound."""

    search: int | None = 4_000  # containers filled in the branch and bound of one block
    nodes: int | None = 400  # steps taken to find the fillings around one item
    branches: int | None = 4  # fillings tried around one item
    exact: int | None = 6  # fillings without waste after which no others are looked for


#: Finds the least number of containers of a block, however long it takes.
EXHAUSTIVE = Effort(None, None, None, None)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; positions of the items in each container."""
    space: list[tuple[int, int]] = []  # (space left, container), sorted
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect.bisect_left(space, (sizes[i], -1))
        if at == len(space):
            bins.append([i])
            bisect.insort(space, (capacity - sizes[i], len(bins) - 1))
        else:
            left, b = space.pop(at)
            bins[b].append(i)
            bisect.insort(space, (left - sizes[i], b))
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound: the sum, and what items that exclude each other leave for those that are not small."""
    ordered = sorted(sizes)
    ahead = [0]
    for s in ordered:
        ahead.append(ahead[-1] + s)
    n, half = len(ordered), bisect.bisect_right(ordered, capacity // 2)
    best = math.ceil(ahead[-1] / capacity)
    for small in {0, *ordered[:half]}:
        alone = bisect.bisect_right(ordered, capacity - small)  # these share with nothing of at least this size
        low = bisect.bisect_left(ordered, small)
        large = alone - min(half, alone)
        room = large * capacity - (ahead[alone] - ahead[min(half, alone)])
        best = max(best, n - alone + large + max(0, math.ceil((ahead[half] - ahead[low] - room) / capacity)))
    return best


class Multiset:
    """Sizes left, as sorted distinct sizes with counts."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = dict(Counter(sizes))
        self.sizes = sorted(self.count)

    def remove(self, s: int, n: int = 1) -> None:
        self.count[s] -= n
        if not self.count[s]:
            del self.count[s]
            self.sizes.pop(bisect.bisect_left(self.sizes, s))

    def add(self, s: int, n: int = 1) -> None:
        if s not in self.count:
            bisect.insort(self.sizes, s)
        self.count[s] = self.count.get(s, 0) + n


def dominated(a: Filling, b: Filling) -> bool:
    """Whether the items of a fit, in groups, into the items of b; then a is never better. Items that both have are left out."""
    x, y = Counter(dict(a)), Counter(dict(b))
    rooms = sorted((y - x).elements())
    for s in sorted((x - y).elements(), reverse=True):
        at = bisect.bisect_left(rooms, s)
        if at == len(rooms):
            return False
        bisect.insort(rooms, rooms.pop(at) - s)
    return True


def fillings(left: Multiset, space: int, most_waste: int, effort: Effort = Effort()) -> list[Filling]:
    """Undominated sets of sizes that fit, least waste first; only those that waste no more than allowed, but at least one.

    Depth first over distinct sizes with their numbers, on an own stack, so a container of many small items is no deeper than it
    has sizes; a branch ends where what is smaller can't use enough of the room.
    """
    sizes, have = left.sizes, left.count
    fits = bisect.bisect_right(sizes, space)
    smaller = [0]  # sum of all items below each size
    for s in sizes[:fits]:
        smaller.append(smaller[-1] + s * have[s])
    found: list[tuple[int, Filling]] = []
    nodes = exact = 0
    room, at = space, fits - 1
    stack: list[list[int]] = []  # place of a size, its number, most of it, room before it
    while True:
        while at >= 0:
            nodes += 1
            s = sizes[at]
            n = min(room // s, have[s])
            stack.append([at, n, n, room])
            room -= n * s
            at = min(at, bisect.bisect_right(sizes, room)) - 1
        if not any(n < most and sizes[k] <= room for k, n, most, _ in stack):  # else one more would fit
            found.append((room, tuple((sizes[k], n) for k, n, _, _ in stack if n)))
            exact += room == 0
        if exact and effort.exact is not None and exact >= effort.exact or effort.nodes is not None and nodes > effort.nodes:
            break
        while stack:
            k, n, most, before = stack[-1]
            room = before - (n - 1) * sizes[k]
            if not n or (found and room - smaller[k] > max(most_waste, 0)):  # fewer leave more room than what is smaller can use
                stack.pop()
                continue
            stack[-1][1] = n - 1
            at = min(k, bisect.bisect_right(sizes, room)) - 1
            break
        else:
            break
    found.sort(key=lambda x: (x[0], sum(n for _, n in x[1])))
    out: list[Filling] = []
    for waste, f in found:
        if out and (waste > most_waste or any(dominated(f, o) for o in out)):
            continue
        out.append(f)
        if len(out) == effort.branches:
            break
    return out


def complete(sizes: list[int], capacity: int, effort: Effort = Effort()) -> list[list[int]]:
    """Bin completion over one block; positions of the items in each container."""
    if not sizes:
        return []
    best = best_fit(sizes, capacity)
    bound = least_bins(sizes, capacity)
    if len(best) <= bound:
        return best
    budget = math.inf if effort.search is None else effort.search
    left = Multiset(sizes)
    spare = -sum(sizes)  # with the capacity of the containers that a better solution may have: the waste that it allows
    chosen: list[Filling] = []
    wasted = 0
    limit = len(best) - 1
    solution: list[Filling] | None = None

    def put(f: Filling, sign: int) -> None:
        nonlocal wasted
        for s, n in f:
            (left.remove if sign > 0 else left.add)(s, n)
        wasted += sign * (capacity - sum(s * n for s, n in f))

    def options() -> list[Filling]:
        big = left.sizes[-1]
        left.remove(big)
        allowed = limit * capacity + spare - wasted
        out = []
        for f in fillings(left, capacity - big, max(allowed, -1), effort):
            if capacity - big - sum(s * n for s, n in f) <= allowed:
                same = next((n for s, n in f if s == big), 0)
                out.append(((big, 1 + same), *[x for x in f if x[0] != big]))
        left.add(big)
        return out

    # depth first over (largest item, filling) with an own stack, as blocks are deep
    stack: list[list] = [[options(), 0]]
    while stack and budget > 0:
        budget -= 1
        todo, at = stack[-1]
        if at >= len(todo):
            stack.pop()
            if chosen and stack:
                put(chosen.pop(), -1)
            continue
        stack[-1][1] += 1
        chosen.append(todo[at])
        put(todo[at], 1)
        if not left.sizes:
            solution = list(chosen)
            limit = len(solution) - 1
            if len(solution) <= bound:
                break
        elif len(chosen) < limit:
            stack.append([options(), 0])
            continue
        put(chosen.pop(), -1)
    if solution is None:
        return best
    where: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        where.setdefault(s, []).append(i)
    return [[where[s].pop() for s, n in c for _ in range(n)] for c in solution]


def _pack_block(pdf: pd.DataFrame, effort: Effort) -> pd.DataFrame:
    pdf = pdf.sort_values(["tokens", "item", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    tokens = [int(x) for x in pdf["tokens"]]
    number, load = [0] * len(pdf), [0] * len(pdf)
    for b, items in enumerate(complete(tokens, int(pdf["capacity"].iloc[0]), effort)):
        filled = sum(tokens[i] for i in items)
        for i in items:
            number[i], load[i] = b, filled
    return pdf.assign(container=pd.Series(number, dtype="int32"), filled=pd.Series(load, dtype="int32"))


SCHEMA = "pack_name string, capacity int, item long, piece_no int, start_token long, tokens int, block long, container int, filled int"


def pack(items: DataFrame, packs: DataFrame, item: str = "doc_id", block_items: int = BLOCK_ITEMS, effort: Effort = Effort()) -> DataFrame:
    """(pack_name, container_id, item, piece_no, start_token, tokens): a place for every item in containers of every pack.

    items: (item, tokens). ``block_items`` bounds what one task packs at once; the packing gets no worse than best-fit in a block.
    ``effort`` bounds the search of a block; EXHAUSTIVE proves the least number of containers of each block.
    """
    sizes = [(r[0], r[1]) for r in bounded_rows(packs.select("pack_name", "capacity_tokens"), MAX_PACKS, "pack sizes") if r[1] and r[1] > 0]
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in sizes]) if sizes else F.array().cast("array<struct<n: string, c: int>>")
    placed = items.where("tokens > 0").select(F.col(item).cast("long").alias("item"), F.col("tokens").alias("_all"), F.explode(each).alias("p"))
    placed = placed.select(F.col("p.n").alias("pack_name"), F.col("p.c").alias("capacity"), "item", "_all")
    pieces = placed.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("_all") - 1) / F.col("capacity")).cast("int"))))
    start = F.col("piece_no").cast("long") * F.col("capacity")
    todo = pieces.select("pack_name", "capacity", "item", "piece_no", start.alias("start_token"), F.least(F.col("capacity").cast("long"), F.col("_all") - start).cast("int").alias("tokens"))
    todo = checkpointed(todo)
    done: list[DataFrame] = []
    run = lambda pdf: _pack_block(pdf, effort)
    alone = todo.where("tokens = capacity")
    # numbered by row, as rows may repeat; the table is checkpointed, so the numbers are the same at each read
    done.append(alone.select("*", F.concat_ws("-", "pack_name", F.lit("full"), F.monotonically_increasing_id()).alias("container_id")))
    todo = todo.where("tokens < capacity")
    before: dict[str, int] = {}
    for r in range(ROUNDS):
        counts = {x[0]: x[1] for x in todo.groupBy("pack_name").count().collect()}  # one row a pack
        if not counts:
            break
        blocks = {n: max(1, math.ceil(c / block_items)) for n, c in counts.items()}
        n_blocks = F.create_map(*[x for n, b in blocks.items() for x in (F.lit(n), F.lit(b))])[F.col("pack_name")]
        keyed = todo.withColumn("block", F.pmod(F.xxhash64("item", "piece_no", F.lit(r)), n_blocks))
        packed = checkpointed(keyed.groupBy("pack_name", "block").applyInPandas(run, SCHEMA))
        last = r == ROUNDS - 1 or counts == before or all(b == 1 for b in blocks.values())
        ready = packed if last else packed.where(F.col("filled") >= FULL * F.col("capacity"))
        name = F.concat_ws("-", "pack_name", F.lit(f"r{r}"), "block", "container")
        done.append(ready.select("pack_name", "capacity", "item", "piece_no", "start_token", "tokens", name.alias("container_id")))
        if last:
            break
        before = counts
        todo = packed.where(F.col("filled") < FULL * F.col("capacity")).select("pack_name", "capacity", "item", "piece_no", "start_token", "tokens")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("pack_name", "container_id", F.col("item").alias(item), "piece_no", "start_token", "tokens")


def pack_texts(docs: DataFrame, packs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, **options) -> DataFrame:
    return pack(token_counts(docs, text, [key], vocabulary), packs, key, **options)


def pack_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: containers, the least number that could do, tokens and share of the space that is filled."""
    per = packed.groupBy("pack_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    out = per.join(F.broadcast(packs.select("pack_name", "capacity_tokens")), "pack_name")
    return out.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("filled_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
