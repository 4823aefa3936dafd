"""Matching two multisets of rows where some pairs are compatible, filing by filing."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def max_flow(supply: list[int], demand: list[int], allowed: set[tuple[int, int]]) -> int:
    """Units that can go from suppliers to allowed consumers, by shortest augmenting paths."""
    n, m = len(supply), len(demand)
    left, room = list(supply), list(demand)
    sent: dict[tuple[int, int], int] = {}
    total = 0
    while True:
        came: dict[tuple[str, int], tuple[str, int] | None] = {("s", i): None for i in range(n) if left[i]}
        queue, end = deque(came), None
        while queue and end is None:
            side, k = queue.popleft()
            nexts = [("d", j) for j in range(m) if (k, j) in allowed] if side == "s" else [("s", i) for i in range(n) if sent.get((i, k), 0)]
            for node in nexts:
                if node not in came:
                    came[node] = (side, k)
                    queue.append(node)
                    if node[0] == "d" and room[node[1]]:
                        end = node
                        break
        if end is None:
            return total
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        units = min(left[path[0][1]], room[end[1]], *(sent[(b[1], a[1])] for a, b in zip(path, path[1:], strict=False) if a[0] == "d"))
        for a, b in zip(path, path[1:], strict=False):
            key = (a[1], b[1]) if a[0] == "s" else (b[1], a[1])
            sent[key] = sent.get(key, 0) + (units if a[0] == "s" else -units)
        left[path[0][1]] -= units
        room[end[1]] -= units
        total += units


def transform_explained(source: DataFrame, repaired: DataFrame, compatible: DataFrame) -> DataFrame:
    """By filing, whether every repaired row comes from a compatible source row and none is left over.

    source and repaired: filing_id, payload, n. compatible: source_payload, repaired_payload. Payloads are
    compatible with themselves.
    """
    pairs = compatible.select("source_payload", "repaired_payload").unionByName(source.select(F.col("payload").alias("source_payload"), F.col("payload").alias("repaired_payload"))).distinct()
    s = source.select("filing_id", F.col("payload").alias("source_payload"), F.col("n").alias("n_source"))
    r = repaired.select("filing_id", F.col("payload").alias("repaired_payload"), F.col("n").alias("n_repaired"))
    edges = s.join(pairs, "source_payload").join(r, ["filing_id", "repaired_payload"]).select("filing_id", "source_payload", "repaired_payload", F.lit(0).alias("n"), F.lit("edge").alias("kind"))
    none = F.lit(None).cast("string")
    nodes = s.select("filing_id", "source_payload", none.alias("repaired_payload"), F.col("n_source").cast("int").alias("n"), F.lit("source").alias("kind")).unionByName(
        r.select("filing_id", none.alias("source_payload"), "repaired_payload", F.col("n_repaired").cast("int").alias("n"), F.lit("repaired").alias("kind"))
    )

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.kind == "source"].reset_index(drop=True), pdf[pdf.kind == "repaired"].reset_index(drop=True)
        at, to = {p: i for i, p in enumerate(a.source_payload)}, {p: i for i, p in enumerate(b.repaired_payload)}
        e = pdf[pdf.kind == "edge"]
        moved = max_flow([int(x) for x in a.n], [int(x) for x in b.n], {(at[x], to[y]) for x, y in zip(e.source_payload, e.repaired_payload, strict=True)})
        return pd.DataFrame([(pdf.filing_id.iloc[0], int(a.n.sum()), int(b.n.sum()), moved)], columns=["filing_id", "n_source", "n_repaired", "n_explained"])

    kind = source.schema["filing_id"].dataType.simpleString()
    out = nodes.unionByName(edges).groupBy("filing_id").applyInPandas(judge, f"filing_id {kind}, n_source long, n_repaired long, n_explained long")
    return out.withColumn("explained", (F.col("n_source") == F.col("n_repaired")) & (F.col("n_explained") == F.col("n_source")))
