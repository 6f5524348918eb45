"""Packing items into containers of fixed capacity: conflict-constrained best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Items per independently packed shard. A shard leaves at most about one container partly filled, a few in ten thousand here.
SHARD_ITEMS = 20_000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Container number of each item (sizes at most ``capacity``); containers are numbered from 0.

    Items are taken by falling size, those of groups with copies for one in 200 of the containers or more before all others, as
    they need that many containers with space left. Open containers stand in order of their free space; each state carries a bitmap of the
    duplicate clusters in it (a cluster number below 0 conflicts with nothing) and one of the sources. The search begins at the
    smallest free space that holds the item and goes on to its successors until it finds one whose clusters don't conflict: the
    tightest compatible container. Among equally tight ones a container without the item's source comes first. Containers with
    the same free space and bitmaps are one state, so that copies of a text don't walk over each other's containers one by one.
    """
    copies = Counter(c for c in clusters if c >= 0)
    often = max(2, sum(sizes) // (capacity * 200))
    order = sorted(range(len(sizes)), key=lambda i: (copies[clusters[i]] <= often, -sizes[i], clusters[i], sources[i], i))
    states: list[tuple[int, int, int]] = []  # (free, cluster bits, source bits), sorted
    held: dict[tuple[int, int, int], list[int]] = {}
    out, n = [0] * len(sizes), 0
    for i in order:
        size, bit, sbit = sizes[i], 1 << clusters[i] if clusters[i] >= 0 else 0, 1 << sources[i]
        at, best = bisect_left(states, (size, -1, -1)), None
        while at < len(states) and (best is None or states[at][0] == best[0]):
            s = states[at]
            if not s[1] & bit:
                if not s[2] & sbit:
                    best = s
                    break
                best = best or s
            at += 1
        if best is None:
            b, n, new = n, n + 1, (capacity - size, bit, sbit)
        else:
            own = held[best]
            b = own.pop()
            if not own:
                del held[best]
                states.pop(bisect_left(states, best))
            new = (best[0] - size, best[1] | bit, best[2] | sbit)
        if new in held:
            held[new].append(b)
        else:
            held[new] = [b]
            insort(states, new)
        out[i] = b
    return out


def pack(docs: DataFrame, containers: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "n_tokens", cluster: str = "cluster", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per container kind and part of a document: ``container, doc_id, part, bin, n_tokens``.

    ``docs`` holds one row per document with its size and the id of its group of copies. A document longer than the capacity is cut
    into full parts, each filling a container of its own, and a rest that is packed like an item; every other document is one
    part 0. Two copies of one text don't share a container, unless a shard holds more copies of it than full containers: then they
    are spread evenly, at most ceil(copies / full containers) in one. Empty documents, and those with a null cluster, go anywhere.
    Documents are spread over shards by a hash of their id and packed within the shard, so no task sees more than about
    ``shard_items`` items, whatever group of copies or source is hot. Null sizes count as 0, null sources as one source. Repeated
    ids are packed once per row. Containers with a null or non-positive capacity are skipped, an empty table gives no rows; other columns are ignored.
    """
    caps = [(r.container, int(r.capacity_tokens)) for r in containers.select("container", "capacity_tokens").filter("capacity_tokens > 0").distinct().orderBy("capacity_tokens", "container").collect()]  # the kinds of container asked for
    items = cut(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"), F.col(cluster).cast("bigint").alias("cluster")))
    shards = max(1, -(-items.count() // shard_items))
    # doc_id and the size in the hash: repeated ids spread as far as their rows differ
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n"], kind="stable")
        ids, sizes = pdf["doc_id"].tolist(), pdf["n"].tolist()
        src = pd.factorize(pdf["source"])[0].tolist()
        many = pdf["cluster"].where(pdf["cluster"].notna() & (pdf["n"] > 0))
        many = many.where(many.duplicated(keep=False))
        base = pd.Series(pd.factorize(many)[0], index=pdf.index)  # -1: no copy in this shard
        copy = base.groupby(base).cumcount()
        rows: list[tuple] = []
        for name, cap in caps:
            rest, full, n = [], [], 0
            for i, s in enumerate(sizes):
                whole = s // cap if s > cap else 0
                full.append(whole)
                rest.append(s - whole * cap if whole else s)
            # A group with more copies than containers are needed would leave them empty: it becomes several groups
            groups = pd.Series(list(zip(base, copy // max(1, sum(rest) // cap)))).where(base.values >= 0)
            at = best_fit(rest, src, pd.factorize(groups)[0].tolist(), cap)
            n = max(at, default=-1) + 1
            for i, (whole, r) in enumerate(zip(full, rest)):
                for p in range(whole):
                    rows.append((name, ids[i], p, f"{name}-{key[0]}-{n}", cap))
                    n += 1
                if r or not whole:
                    rows.append((name, ids[i], whole, f"{name}-{key[0]}-{at[i]}", r))
        return pd.DataFrame(rows, columns=["container", "doc_id", "part", "bin", "n_tokens"])

    kind = items.schema["doc_id"].dataType.simpleString()
    # each shard is a good deal of work for few bytes: keep them apart, at most a few to a task
    return items.repartition(max(min(2 * shards, 2_000), shards // 4), "shard").groupBy("shard").applyInPandas(run, f"container string, doc_id {kind}, part int, bin string, n_tokens bigint")


def report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container kind: ``container, capacity_tokens, n_bins, n_docs, n_tokens, fill`` (share of the space used)."""
    bins = packed.groupBy("container", "bin").agg(F.sum("n_tokens").alias("t"))
    sums = bins.groupBy("container").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("t").alias("n_tokens"))
    docs = packed.filter("part = 0").groupBy("container").agg(F.count(F.lit(1)).alias("n_docs"))
    c = containers.select("container", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    out = c.join(sums, "container").join(docs, "container")
    return out.select("container", "capacity_tokens", "n_bins", "n_docs", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("fill"))
