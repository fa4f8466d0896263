"""The graph of accounts and counterparties: edges, rings, projection, paths, communities, ownership, flows.

Times come as as_of, never from a clock. Joins on a shared counterparty run over
edges (one row for each account and counterparty), after the lookback, so a hub
costs the square of its accounts and not of its transactions; pair joins are left
to AQE's skew splitting.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from itertools import count, groupby, islice
from operator import itemgetter
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.functions.text import key
from ledgerwatch.sources.shared import ready_to_checkpoint

#: Level by level loops cut their plan after so many rounds.
CUT_EVERY = 4

#: Edges by the types of their ends, and how many ends of transactions a task sums.
EDGE_KINDS = (("account", "counterparty"), ("account", "merchant"), ("customer", "counterparty"))
ENDS_PER_TASK = 500_000


def since(rows: DataFrame, col: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col(col) >= as_of - F.make_dt_interval(days=F.lit(days)))


def build_edges(txns: DataFrame, rows: int | None = None, kinds: Sequence[tuple[str, str]] = EDGE_KINDS) -> DataFrame:
    """account->counterparty, account->merchant and customer->counterparty edges with first and last time and count.

    kinds leaves out the edges that nobody asks for. An account and a customer of one id
    share their rows up to the end. With the number of transactions given (rows), edges are
    dealt into so many tasks that none grows with the ledger; few transactions repeat an edge,
    so nothing is summed before.
    """
    account, customer = F.col("account_id"), F.col("customer_id")
    to = {d: key(F.col(d)) for d in ("counterparty", "merchant")}
    end = lambda src, a, c, d: F.struct(src.alias("src_id"), a.alias("__a"), c.alias("__c"), F.lit(d == "merchant").alias("__m"), to[d].alias("dst_key"))
    yes, no, ends = F.lit(True), F.lit(False), []
    if ("account", "counterparty") in kinds and ("customer", "counterparty") in kinds:
        same = account.eqNullSafe(customer)
        ends = [end(account, yes, same, "counterparty"), end(customer, no, ~same, "counterparty")]
    elif ("account", "counterparty") in kinds:
        ends = [end(account, yes, no, "counterparty")]
    elif ("customer", "counterparty") in kinds:
        ends = [end(customer, no, yes, "counterparty")]
    if ("account", "merchant") in kinds:
        ends.append(end(account, yes, no, "merchant"))
    found = txns.select("ts", F.explode(F.filter(F.array(*ends), lambda e: (e["dst_key"] != "") & (e["__a"] | e["__c"]))).alias("e")).select("e.*", "ts")
    if rows is not None:
        tasks = max(txns.sparkSession.sparkContext.defaultParallelism, len(ends) * rows // ENDS_PER_TASK)
        found = found.repartition(tasks, "src_id", "dst_key")
    facts = lambda c: F.struct(F.min(F.when(c, F.col("ts"))).alias("first_seen_at"), F.max(F.when(c, F.col("ts"))).alias("last_seen_at"), F.count_if(c).alias("txn_count"))
    sums = found.groupBy("src_id", "__m", "dst_key").agg(facts(F.col("__a")).alias("account"), facts(F.col("__c")).alias("customer"))
    by = F.array(*[F.struct(F.lit(t).alias("src_type"), F.col(t).alias("f")) for t in ("account", "customer") if any(t == k for k, _ in kinds)])
    out = sums.select("src_id", "__m", "dst_key", F.explode(F.filter(by, lambda e: e["f"]["txn_count"] > 0)).alias("e"))
    return out.select("e.src_type", "src_id", F.when(F.col("__m"), "merchant").otherwise("counterparty").alias("dst_type"), "dst_key", "e.f.*")


def has_edge() -> Column:
    """Whether a transaction makes an edge of its account."""
    return (key(F.col("counterparty")) != "") | (key(F.col("merchant")) != "")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new merged in: earlier first time, later last time, the new count; edges that are in neither go nowhere."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy("src_type", "src_id", "dst_type", "dst_key").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max_by("txn_count", "__new").alias("txn_count")
    )


def account_edges(edges: DataFrame) -> DataFrame:
    """account_id and dst_key of account->counterparty edges, with their times and counts."""
    chosen = edges.where("src_type = 'account' and dst_type = 'counterparty'")
    return chosen.select(F.col("src_id").alias("account_id"), "dst_key", "first_seen_at", "last_seen_at", "txn_count")


def linked_pairs(edges: DataFrame) -> DataFrame:
    """a, b, dst_key for accounts that share a counterparty, both ways."""
    e = account_edges(edges).select("account_id", "dst_key")
    other = e.select(F.col("account_id").alias("b"), "dst_key")
    return e.join(other, "dst_key").where("account_id <> b").select(F.col("account_id").alias("a"), "b", "dst_key")


def ring_signals(edges: DataFrame, as_of: Column, lookback_days: int = 30) -> DataFrame:
    """For each account with a shared counterparty: overlap_count, linked accounts, shared counterparties, degree."""
    recent = since(edges, "last_seen_at", as_of, lookback_days)
    pairs = linked_pairs(recent)
    sums = pairs.groupBy(F.col("a").alias("account_id")).agg(
        F.sort_array(F.collect_set("b")).alias("linked_accounts"), F.sort_array(F.collect_set("dst_key")).alias("shared_counterparties")
    )
    degree = account_edges(recent).groupBy("account_id").agg(F.count(F.lit(1)).alias("degree"))
    return sums.join(degree, "account_id").withColumn("overlap_count", F.size("shared_counterparties"))


def rings(signals: DataFrame, min_shared: int = 2, min_linked: int = 2) -> DataFrame:
    return signals.where((F.col("overlap_count") >= min_shared) & (F.size("linked_accounts") >= min_linked))


def neighbourhood(edges: DataFrame, account_id: int, as_of: Column, lookback_days: int = 30) -> DataFrame:
    """An account's edges by (dst_type, dst_key), numbered by place, each with the account's ring: overlap_count, linked, degree.

    Only edges of the account and of those that share a counterparty with it are joined.
    """
    mine = edges.where((F.col("src_type") == "account") & (F.col("src_id") == account_id))
    near = account_edges(since(edges, "last_seen_at", as_of, lookback_days))
    own = near.where(F.col("account_id") == account_id).select("dst_key")
    others = near.where(F.col("account_id") != account_id).join(own, "dst_key", "left_semi")
    ring = others.agg(F.count_distinct("dst_key").alias("overlap_count"), F.count_distinct("account_id").alias("linked"))
    ring = ring.join(own.agg(F.count(F.lit(1)).alias("degree")))  # a row each
    place = F.row_number().over(Window.partitionBy("src_id").orderBy("dst_type", "dst_key")).cast("bigint")
    return mine.withColumn("place", place).join(F.broadcast(ring)).orderBy("place")


def projection(edges: DataFrame) -> DataFrame:
    """Directed edges src -> dst between accounts that share counterparties: times, counts and the shared ones."""
    e = account_edges(edges)
    other = e.select(F.col("account_id").alias("dst"), "dst_key", F.col("first_seen_at").alias("f2"), F.col("last_seen_at").alias("l2"), F.col("txn_count").alias("c2"))
    j = e.join(other, "dst_key").where("account_id <> dst")
    return j.groupBy(F.col("account_id").alias("src"), "dst").agg(
        F.min(F.least("first_seen_at", "f2")).alias("first_seen_at"), F.max(F.greatest("last_seen_at", "l2")).alias("last_seen_at"),
        F.sum(F.col("txn_count") + F.col("c2")).alias("txn_count"), F.sort_array(F.collect_set("dst_key")).alias("shared_counterparties"),
    )


def nodes(accounts: DataFrame, customers: DataFrame, txns: DataFrame, alerts: DataFrame) -> DataFrame:
    """Account nodes with their customer, transaction volume and alert count; 0 where there is none."""
    volume = txns.groupBy("account_id").agg(F.sum("amount").alias("total_amount"))
    counts = alerts.join(txns.select(F.col("id").alias("transaction_id"), "account_id"), "transaction_id").groupBy("account_id").agg(F.count(F.lit(1)).alias("alert_count"))
    base = accounts.select(F.col("id").alias("account_id"), "customer_id", "iban_or_acct").join(
        customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"), "country", "base_risk"), "customer_id"
    )
    return (
        base.join(volume, "account_id", "left").join(counts, "account_id", "left")
        .withColumns({"total_amount": F.coalesce("total_amount", F.lit(0.0)), "alert_count": F.coalesce("alert_count", F.lit(0).cast("bigint"))})
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) both ways from edges with src and dst."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    return e.union(e.select("b", "a")).distinct()


def _cut(df: DataFrame, round_: int) -> DataFrame:
    """Ends the plan's growth every few rounds, by a checkpoint in the shared folder."""
    if round_ % CUT_EVERY:
        return df
    ready_to_checkpoint(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df made once, in the shared folder, for plans that read it many times."""
    return _cut(df, CUT_EVERY)


def k_hop(edges: DataFrame, start: int, hops: int) -> DataFrame:
    """node and its distance from start, up to hops."""
    return _k_hop(kept(undirected(edges)), start, hops)


def _k_hop(pairs: DataFrame, start: int, hops: int) -> DataFrame:
    seen = pairs.sparkSession.createDataFrame([(start, 0)], "node long, hop int")
    front = seen
    for h in range(1, hops + 1):
        near = pairs.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        front = near.join(seen, "node", "left_anti").withColumn("hop", F.lit(h))
        seen = _cut(seen.unionByName(front), h)
    return seen


def subgraph(edges: DataFrame, start: int, hops: int) -> DataFrame:
    """The edges between nodes within hops of start."""
    near = k_hop(edges, start, hops).select("node")
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def simple_paths(edges: DataFrame, start: int, end: int, max_hops: int) -> DataFrame:
    """path (array of nodes) of every simple path of at most max_hops edges; undirected."""
    # Only nodes that can still reach the end in time are walked on.
    pairs = kept(undirected(edges))
    left = _k_hop(pairs, end, max_hops).select(F.col("node").alias("b"), F.col("hop").alias("to_go"))
    walks = pairs.sparkSession.createDataFrame([([start],)], "path array<long>")
    found = []
    for h in range(1, max_hops + 1):
        walks = walks.withColumn("a", F.element_at("path", -1)).join(pairs, "a").join(left, "b")
        walks = walks.where(~F.array_contains("path", F.col("b")) & (F.col("to_go") <= max_hops - h))
        walks = walks.select(F.concat("path", F.array("b")).alias("path"))
        found.append(walks.where(F.element_at("path", -1) == end))
        walks = walks.where(F.element_at("path", -1) != end)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def shortest_path(edges: DataFrame, start: int, end: int, max_hops: int | None = None) -> DataFrame:
    """path: of the shortest paths the one of the least nodes in order; no row where there is none (of max_hops edges, if given).

    Each round keeps one path for each node, so the front is never larger than the graph.
    """
    pairs = _cut(undirected(edges), CUT_EVERY)
    seen = pairs.sparkSession.createDataFrame([(start, [start])], "node long, path array<long>")
    front = seen
    for h in count(1):
        if (max_hops is not None and h > max_hops) or seen.where(F.col("node") == end).limit(1).count():
            break
        grown = front.withColumnRenamed("node", "a").join(pairs, "a").select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        front = grown.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti")
        front = _cut(front, CUT_EVERY)
        if not front.limit(1).count():
            break
        seen = _cut(seen.unionByName(front), h)
    return seen.where(F.col("node") == end).select("path")


def _may_move(source: str, target: str, round_: int) -> Column:
    """Labels are in one of two halves, drawn anew each round: moves go from the first to the second alone.

    So no node goes to a label that another one leaves in the same round.
    """
    half = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(round_)), F.lit(2))
    return (half(source) == 0) & (half(target) == 1)


def label_propagation(edges: DataFrame) -> DataFrame:
    """node and community, where each node has a most frequent label among its neighbours: of equal ones its own, else the least.

    Rounds go on until no node wants another label. In a round half of the nodes, drawn by
    hash, get their wish; where that leaves no more edges inside labels than before, nodes
    move between the halves of _may_move in its place, which always gains. So rounds can't
    go in circles.
    """
    pairs = _cut(undirected(edges), CUT_EVERY)
    labels = pairs.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    kept, most = None, -1
    for r in count(1):
        votes = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.count(F.lit(1)).alias("n"))
        votes = votes.join(labels.withColumnRenamed("community", "own"), "node")
        wishes = votes.groupBy("node", "own").agg(
            F.max_by("community", F.struct("n", F.col("community") == F.col("own"), -F.col("community"))).alias("wish"),
            F.max(F.when(F.col("community") == F.col("own"), F.col("n"))).alias("inside"),
        )
        wishes = _cut(wishes, CUT_EVERY)
        wanting, inside = wishes.agg(F.count_if(F.col("wish") != F.col("own")), F.coalesce(F.sum("inside"), F.lit(0))).first()
        if inside > most:
            if not wanting:
                return wishes.select("node", F.col("own").alias("community"))
            kept, most, may = wishes, inside, F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        else:
            may = _may_move("own", "wish", r)
        labels = kept.select("node", F.when(may, F.col("wish")).otherwise(F.col("own")).alias("community"))


def connected(edges: DataFrame) -> DataFrame:
    """node and component, the least node of its component."""
    pairs = _cut(undirected(edges), CUT_EVERY)
    labels = pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = lower.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component"))
        after = _cut(after, CUT_EVERY)
        if not after.where("was <> component").limit(1).count():
            return after.select("node", "component")
        labels = after.select("node", "component")


def louvain(edges: DataFrame, seed: int = 42, max_component: int = 200_000) -> DataFrame:
    """node and community by modularity, unweighted; each connected component by itself.

    A component of over max_component nodes doesn't fit one task; its nodes are moved
    and its communities contracted by joins.
    """
    import pandas as pd

    edges = kept(undirected(edges).where("a < b").toDF("src", "dst"))
    comp = kept(connected(edges))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = size.where(F.col("n") > max_component).select("component")
    pairs = edges.toDF("a", "b").join(comp.withColumnRenamed("node", "a"), "a")
    small = pairs.join(large, "component", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task's rows are sorted by component, which may go on in the next frame.
        rows = ((c, (a, b)) for pdf in frames for c, a, b in zip(pdf["component"].tolist(), pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
        found = (x for _, part in groupby(rows, key=itemgetter(0)) for x in _louvain_local([p for _, p in part], seed).items())
        while some := list(islice(found, 10_000)):
            yield pd.DataFrame(some, columns=["node", "community"])

    dealt = small.repartition("component").sortWithinPartitions("component").select("component", "a", "b")
    out = dealt.mapInPandas(run, "node long, community long")
    rest = pairs.join(large, "component", "left_semi").select("component", "a", "b")
    return out.unionByName(_louvain_spread(rest)) if large.limit(1).count() else out


def _louvain_spread(pairs: DataFrame) -> DataFrame:
    """node and community, named by its least node, for components too large for a task; pairs has component, a < b."""
    one = F.lit(1.0).alias("w")
    graph = _cut(pairs.select("component", "a", "b", one).union(pairs.select("component", "b", "a", one)), CUT_EVERY)
    total = _cut(graph.groupBy("component").agg(F.sum("w").alias("total")), CUT_EVERY)
    member = graph.select(F.col("a").alias("node")).distinct().withColumn("at", F.col("node"))
    while True:
        labels, moved = _moved(graph, total)
        if not moved:
            break
        member = _cut(member.join(labels.select(F.col("node").alias("at"), "own"), "at").select("node", F.col("own").alias("at")), CUT_EVERY)
        a, b = (labels.select(F.col("node").alias(x), F.col("own").alias(f"{x}_at")) for x in "ab")
        graph = graph.join(a, "a").join(b, "b").groupBy("component", F.col("a_at").alias("a"), F.col("b_at").alias("b")).agg(F.sum("w").alias("w"))
        graph = _cut(graph, CUT_EVERY)
    least = member.groupBy("at").agg(F.min("node").alias("community"))
    return member.join(least, "at").select("node", "community")


def _moved(graph: DataFrame, total: DataFrame) -> tuple[DataFrame, bool]:
    """node and own (its community) once no node gains by moving, and whether any has moved.

    All moves that _may_move allows are made together where that raises the modularity. Else
    only one from and one to each community: those don't touch each other's gains, so
    the modularity rises with every round, and rounds end.
    """
    base = graph.groupBy("component", F.col("a").alias("node")).agg(F.sum("w").alias("deg")).join(total, "component")
    labels = _cut(base.select("node", F.col("node").alias("own"), "deg", "total"), CUT_EVERY)
    value, moved = _modularity(graph, labels), False
    for r in count(1):
        near = graph.where("a <> b").join(labels.select(F.col("node").alias("b"), F.col("own").alias("to")), "b").select(F.col("a").alias("node"), "to", "w")
        near = near.union(labels.select("node", F.col("own").alias("to"), F.lit(0.0).alias("w"))).groupBy("node", "to").agg(F.sum("w").alias("w"))
        sums = labels.groupBy(F.col("own").alias("to")).agg(F.sum("deg").alias("sum"))
        here = F.col("to") == F.col("own")
        gain = F.col("w") - (F.col("sum") - F.when(here, F.col("deg")).otherwise(0.0)) * F.col("deg") / F.col("total")
        gains = near.join(sums, "to").join(labels, "node").withColumn("gain", gain)
        wishes = gains.groupBy("node", "own", "deg", "total").agg(
            F.max_by("to", F.struct("gain", -F.col("to"))).alias("wish"), (F.max("gain") - F.max(F.when(here, F.col("gain")))).alias("more")
        )
        wishes = _cut(wishes.withColumn("wish", F.when(F.col("more") > 1e-9, F.col("wish")).otherwise(F.col("own"))), CUT_EVERY)
        if not wishes.where("wish <> own").limit(1).count():
            return labels, moved
        may = _may_move("own", "wish", r)
        if not wishes.where(may).limit(1).count():
            continue
        after = _cut(wishes.select("node", F.when(may, F.col("wish")).otherwise(F.col("own")).alias("own"), "deg", "total"), CUT_EVERY)
        now = _modularity(graph, after)
        if now <= value + 1e-12:
            first = lambda df, by: df.groupBy(by).agg(F.max_by(F.struct("node", "own", "wish", "more"), F.struct("more", -F.col("node"))).alias("m")).select("m.*")
            chosen = first(first(wishes.where(may), "wish"), "own").select("node", F.col("wish").alias("goes"))
            after = wishes.join(chosen, "node", "left").select("node", F.coalesce("goes", "own").alias("own"), "deg", "total")
            after = _cut(after, CUT_EVERY)
            now = _modularity(graph, after)
        labels, value, moved = after, now, True


def _modularity(graph: DataFrame, labels: DataFrame) -> float:
    """The sum of the components' modularities."""
    a = labels.select(F.col("node").alias("a"), F.col("own").alias("a_at"), "total")
    b = labels.select(F.col("node").alias("b"), F.col("own").alias("b_at"))
    inside = graph.join(a, "a").join(b, "b").where("a_at = b_at").agg(F.sum(F.col("w") / F.col("total"))).first()[0]
    spread = labels.groupBy("own").agg((F.sum("deg") / F.first("total")).alias("share")).agg(F.sum(F.col("share") * F.col("share"))).first()[0]
    return (inside or 0.0) - spread


def _louvain_local(pairs: list[tuple[int, int]], seed: int) -> dict[int, int]:
    """Communities of one component, named by their least node."""
    import random

    rng = random.Random(seed)
    graph: dict[int, dict[int, float]] = {}
    for a, b in pairs:
        graph.setdefault(int(a), {})[int(b)] = 1.0
        graph.setdefault(int(b), {})[int(a)] = 1.0
    total = sum(sum(v.values()) for v in graph.values())
    member = {v: v for v in graph}
    while True:
        at = {v: v for v in graph}
        degree = {v: sum(n.values()) for v, n in graph.items()}
        weight = dict(degree)
        moved_any, moved = False, True
        while moved:
            moved, order = False, sorted(graph)
            rng.shuffle(order)
            for v in order:
                near: dict[int, float] = {}
                for u, w in graph[v].items():
                    if u != v:
                        near[at[u]] = near.get(at[u], 0.0) + w
                weight[at[v]] -= degree[v]
                gain = lambda c: near.get(c, 0.0) - weight.get(c, 0.0) * degree[v] / total  # noqa: B023, E731
                best = max(sorted({*near, at[v]}), key=gain)
                if gain(best) <= gain(at[v]) + 1e-12:
                    best = at[v]
                weight[best] = weight.get(best, 0.0) + degree[v]
                if best != at[v]:
                    at[v], moved, moved_any = best, True, True
        if not moved_any:
            break
        member = {v: at[c] for v, c in member.items()}
        joined: dict[int, dict[int, float]] = {}
        for v, near_ in graph.items():
            row = joined.setdefault(at[v], {})
            for u, w in near_.items():
                row[at[u]] = row.get(at[u], 0.0) + w
        graph = joined
    least: dict[int, int] = {}
    for v, c in member.items():
        least[c] = min(v, least.get(c, v))
    return {v: least[c] for v, c in member.items()}


def suspicious(members: DataFrame, node_facts: DataFrame, min_alert_ratio: float = 0.3) -> DataFrame:
    """Communities whose share of accounts with alerts reaches the ratio, with a risk score; the riskiest first.

    members: node, community; node_facts: account_id, alert_count, total_amount.
    """
    j = members.join(node_facts.select(F.col("account_id").alias("node"), "alert_count", "total_amount"), "node")
    out = j.groupBy("community").agg(
        F.count(F.lit(1)).alias("size"), F.sum("alert_count").alias("alerts"),
        (F.count_if(F.col("alert_count") > 0) / F.count(F.lit(1))).alias("alert_ratio"), F.sum("total_amount").alias("volume"),
    )
    risk = 50 * F.col("alert_ratio") + 2 * F.least("alerts", F.lit(20)) + F.least("size", F.lit(10))
    return out.where(F.col("alert_ratio") >= min_alert_ratio).withColumn("risk_score", F.round(risk, 2)).orderBy(F.desc("risk_score"), "community")


def common_owners(accounts: DataFrame, customers: DataFrame, ids: DataFrame) -> DataFrame:
    """Customers that own two or more of the accounts in ids (account_id)."""
    chosen = accounts.join(ids.select(F.col("account_id").alias("id")), "id", "left_semi")
    owned = chosen.groupBy("customer_id").agg(F.sort_array(F.collect_set("id")).alias("account_ids")).where(F.size("account_ids") >= 2)
    return owned.join(customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"), "country", "base_risk"), "customer_id")


def ownership_links(edges: DataFrame, min_shared: int = 2) -> DataFrame:
    """account_id, linked_account and shared_count of all accounts that share min_shared counterparties, without lookback."""
    pairs = linked_pairs(edges).groupBy(F.col("a").alias("account_id"), F.col("b").alias("linked_account"))
    return pairs.agg(F.count_distinct("dst_key").alias("shared_count")).where(F.col("shared_count") >= min_shared)


def ownership_chain(edges: DataFrame, accounts: DataFrame, customers: DataFrame, account_id: int) -> DataFrame:
    """The direct owner of an account, and the owners of accounts that share two counterparties with it."""
    owner = accounts.select(F.col("id").alias("linked_account"), "customer_id")
    who = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    direct = owner.where(F.col("linked_account") == account_id).withColumns({"relation": F.lit("direct_owner"), "shared_count": F.lit(0).cast("bigint")})
    mine = account_edges(edges).where(F.col("account_id") == account_id).select("dst_key")
    near = account_edges(edges).where(F.col("account_id") != account_id).join(mine, "dst_key", "left_semi")
    near = near.groupBy(F.col("account_id").alias("linked_account")).agg(F.count_distinct("dst_key").alias("shared_count")).where("shared_count >= 2")
    linked = near.join(owner, "linked_account").withColumn("relation", F.lit("shared_counterparties"))
    return direct.unionByName(linked, allowMissingColumns=True).join(who, "customer_id")


def flow_edges(txns: DataFrame, accounts: DataFrame, as_of: Column, direction: str = "out", lookback_days: int = 90) -> DataFrame:
    """account, counterparty, the account that it is (-1 if none), amount and count, over the lookback."""
    recent = since(txns, "ts", as_of, lookback_days).where((F.col("direction") == direction) & (key(F.col("counterparty")) != ""))
    sums = recent.groupBy("account_id", key(F.col("counterparty")).alias("counterparty")).agg(F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("txn_count"))
    known = accounts.select(key(F.col("iban_or_acct")).alias("counterparty"), F.col("id").alias("to_account"))
    return sums.join(known, "counterparty", "left").withColumn("to_account", F.coalesce("to_account", F.lit(-1).cast("bigint")))


def trace_flow(flows: DataFrame, start: int, depth: int = 3) -> DataFrame:
    """parent, child, counterparty, amount, count and depth of the money's way from start; each account is entered once."""
    seen = flows.sparkSession.createDataFrame([(start,)], "node long")
    front, out = seen, None
    for d in range(1, depth + 1):
        step = flows.join(front.select(F.col("node").alias("account_id")), "account_id")
        step = step.join(seen.select(F.col("node").alias("to_account")), "to_account", "left_anti")
        # Of several ways into an account the one from the least account counts.
        first = step.where("to_account >= 0").groupBy("to_account").agg(F.min("account_id").alias("account_id"))
        kept = step.where("to_account < 0").unionByName(step.join(first, ["to_account", "account_id"], "left_semi"))
        kept = _cut(kept.select(F.col("account_id").alias("parent"), F.col("to_account").alias("child"), "counterparty", "total_amount", "txn_count", F.lit(d).alias("depth")), CUT_EVERY)
        out = kept if out is None else out.unionByName(kept)
        front = kept.where("child >= 0").select(F.col("child").alias("node")).distinct()
        seen = seen.unionByName(front)
    return out


def d3(node_rows: DataFrame, edges: DataFrame, members: DataFrame | None = None, community: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and links as JSON lines, ready to be put in {nodes, links}."""
    n = node_rows.withColumn("id", F.col("account_id"))
    if members is not None:
        n = n.join(members.withColumnRenamed("node", "account_id"), "account_id", "left")
        if community is not None:
            n = n.where(F.col("community") == community)
            edges = edges.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
    links = edges.withColumnsRenamed({"src": "source", "dst": "target"})
    return n.select(F.to_json(F.struct(*n.columns)).alias("json")), links.select(F.to_json(F.struct(*links.columns)).alias("json"))


def assembled(parts: Mapping[str, DataFrame], out: TextIO) -> None:
    """One JSON object of lists, such as {nodes, links}, from frames of JSON lines, row by row."""
    for i, (name, rows) in enumerate(parts.items()):
        out.write(("{" if i == 0 else "],") + json.dumps(name) + ":[")
        for j, (line,) in enumerate(rows.select("json").toLocalIterator()):
            out.write(("," if j else "") + line)
    out.write("]}")


def cytoscape(node_rows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as {data: ...} JSON lines with ids as text."""
    n = node_rows.withColumn("id", F.col("account_id").cast("string"))
    e = edges.withColumns({"id": F.concat_ws("-", "src", "dst"), "source": F.col("src").cast("string"), "target": F.col("dst").cast("string")}).drop("src", "dst")
    wrap = lambda df: df.select(F.to_json(F.struct(F.struct(*df.columns).alias("data"))).alias("json"))
    return wrap(n), wrap(e)
