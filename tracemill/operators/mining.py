"""Template mining: which messages are instances of one template.

All steps are set operations on distinct messages, so the result depends on the messages alone, not on their number,
order, partitions or tasks:

1. Messages fall into leaves by token count and leading tokens; only messages of one leaf can share a template.
2. A token that two or more messages of a leaf have at one position is a constant there; the other tokens are parameters. A
   message's signature is its set of constants with their positions. A message with fewer constants than ``sim_th`` of its
   length resembles no other and is a template of its own.
3. Signatures of a leaf stand in the order of their message counts. Each joins the most similar one before it: the one with
   the most constants in common (at least ``sim_th`` of the length); of equally similar ones the one that shares its rarest
   constant, and of those the earliest. Joined signatures form a cluster.
4. A cluster's template keeps a token where all of its messages agree.

A leaf of up to ``LEAF_TOKENS`` tokens is compared within one task: its messages are shuffled once, and no token, signature or pair
is. Larger leaves are compared by joins over all tasks, with the same result.

Step 3 reads an inverted index from (leaf, position, token) to signatures, rarest constants first. Once a signature has looked
up its j rarest constants, one that it has not met shares at most the others; so it stops when its best match is that
similar, and at the latest when what remains is below ``sim_th``. Frequent constants, with long lists, are read only for the
few signatures that their rare ones leave open.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import WILDCARD
from tracemill.operators import templates
from tracemill.operators.lookup import lookup
from tracemill.session import stored

# Constants are looked up in rounds, by the number of messages that have them.
TIERS = (16, 256, 4096, None)
# Tokens that a group of small leaves has on average, and the most of a leaf that goes to one task.
GROUP_TOKENS = 1_000_000
LEAF_TOKENS = 16_000_000


def tokens(message: Column) -> Column:
    return F.filter(F.split(message, r"(?U)\s+"), lambda t: t != "")


def _prefix(token_array: Column, depth: int) -> Column:
    """Leading tokens that choose the leaf; tokens with a digit count as wildcards."""
    head = F.slice(token_array, 1, max(0, depth - 3))
    return F.concat_ws(" ", F.transform(head, lambda t: F.when(F.rlike(t, F.lit(r"(?U)\d")), WILDCARD).otherwise(t)))


def leaves(messages: DataFrame, depth: int, max_children: int) -> tuple[DataFrame, DataFrame]:
    """``messages`` with ``leaf``, ``size`` and ``tokens``, and the tokens of each leaf (leaf, n_tokens). For each token count the
    ``max_children`` most frequent prefixes keep a leaf of their own and the others share the wildcard leaf, whatever order lines
    arrive in."""
    keyed = messages.withColumn("tokens", tokens(F.col("masked"))).withColumn("size", F.size("tokens"))
    keyed = keyed.withColumn("_prefix", _prefix(F.col("tokens"), depth))
    ranking = Window.partitionBy("size").orderBy(F.desc("n"), "_prefix")
    prefixes = stored(
        keyed.groupBy("size", "_prefix")
        .agg(F.sum("n").alias("n"), (F.col("size") * F.count(F.lit(1))).alias("_tokens"))
        .withColumn("_own", F.row_number().over(ranking) <= max_children)
    )
    own = prefixes.where("_own").select("size", "_prefix", "_own")
    name = F.concat_ws(" ", F.col("size").cast("string"), F.when(F.col("_own"), F.col("_prefix")).otherwise(F.lit(WILDCARD)))
    # At most max_children rows for each token count.
    placed = keyed.join(F.broadcast(own), ["size", "_prefix"], "left").withColumn("leaf", name).drop("_prefix", "_own")
    return placed, prefixes.groupBy(name.alias("leaf")).agg(F.sum("_tokens").alias("n_tokens"))


def _keys(of: Callable[[Column, Column], Column]) -> Column:
    """``of`` (position, key) of each token; the key is a 64-bit hash of leaf, position and token, and NULL of a wildcard."""
    return F.transform("tokens", lambda t, at: of(at, F.when(t != WILDCARD, F.xxhash64(F.xxhash64("leaf"), at, t))))


def _constants(placed: DataFrame) -> DataFrame:
    """(first_line, leaf, size, items): ``items`` holds (n, at, key) of each constant of a message, rarest first.

    ``key`` is a 64-bit hash of leaf, position and token, ``n`` the number of messages that have it. ``leaf`` is a hash.
    """
    keys = F.filter(_keys(lambda at, key: F.struct(at.alias("at"), key.alias("key"))), lambda k: k["key"].isNotNull())
    keyed = stored(placed.select("first_line", F.xxhash64("leaf").alias("leaf"), "size", keys.alias("keys")))
    counts = keyed.select(F.explode("keys.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A message has one more row, without a key, so that those without constants are kept.
    none = F.array(F.lit(None).cast("struct<at:int,key:bigint>"))
    rows = keyed.select("first_line", "leaf", "size", F.explode(F.concat(none, "keys")).alias("k")).select("first_line", "leaf", "size", "k.at", "k.key")
    counted = rows.join(stored(counts), "key", "left").where("n IS NOT NULL OR key IS NULL")
    item = F.when(F.col("n").isNotNull(), F.struct("n", "at", "key"))
    return counted.groupBy("first_line", "leaf", "size").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _most_similar(signatures: DataFrame, sim_th: float) -> DataFrame:
    """(id, up): the earlier signature that each of stored ``signatures`` (leaf, size, items, m, id) joins, if any."""
    least = F.greatest(F.lit(1), F.ceil(F.lit(float(sim_th)) * F.col("size")).cast("int"))
    # Of so many constants, the rarest ones, at least one is shared with any signature that is similar enough.
    prefix = F.size("items") - least + 1
    ends = signatures.select("id", "m", F.col("items.key").alias("keys"))
    none = F.lit(None).cast("struct<less:int,rank:bigint,m:bigint,up:bigint>")
    todo = signatures.where(prefix > 0).select("id", "m", "items", least.alias("least"), prefix.alias("prefix"), none.alias("best"))
    found = None
    low = 0
    for high in TIERS:
        here = F.filter("items", _between(low, high))
        table = signatures.select(F.col("id").alias("up"), F.col("m").alias("m_up"), F.explode(here).alias("i")).select("i.key", "up", "m_up")
        first = F.slice("items", F.lit(1), F.col("prefix"))
        asked = todo.select("id", "m", F.explode(F.filter(first, _between(low, high))).alias("i")).select("i.key", "id", "m")
        met = asked.join(table, "key").where("m_up > m OR m_up = m AND up < id").select("id", "up").distinct()
        both = met.join(ends.select("id", "keys"), "id").join(ends.select(F.col("id").alias("up"), F.col("m").alias("m_up"), F.col("keys").alias("keys_up")), "up")
        common = both.withColumn("common", F.array_intersect("keys", "keys_up"))
        scored = common.select("id", F.struct(
            (-F.size("common")).alias("less"), F.array_position("keys", F.get("common", F.lit(0))).alias("rank"), (-F.col("m_up")).alias("m"), "up"
        ).alias("new"))
        best = scored.groupBy("id").agg(F.min("new").alias("new"))
        todo = todo.join(best, "id", "left").withColumn("best", F.least("best", "new")).drop("new")
        seen = F.col("prefix") if high is None else F.least(F.col("prefix"), F.size(F.filter("items", _between(0, high))))
        todo = stored(todo.withColumn("open", (seen < F.col("prefix")) & (F.coalesce(-F.col("best.less"), F.lit(0)) < F.size("items") - seen)))
        done = todo.where("NOT open AND -best.less >= least").select("id", "best.up")
        found = done if found is None else found.union(done)
        todo = todo.where("open").drop("open")
        if todo.isEmpty():
            break
        low = high
    if sim_th > 0:
        return found
    # Without a threshold, signatures that share no constant join the first of their leaf.
    lead = signatures.groupBy("leaf").agg(F.min_by("id", F.struct(-F.col("m"), F.col("id"))).alias("up"))
    rest = signatures.join(found, "id", "left_anti").join(lead, "leaf").where("id != up").select("id", "up")
    return found.union(rest)


def _between(low: int, high: int | None):
    return lambda i: i["n"] > low if high is None else (i["n"] > low) & (i["n"] <= high)


def _roots(links: DataFrame) -> DataFrame:
    """(id, cluster): the end of each chain of ``links`` (id, up); chains shorten by doubling."""
    at = stored(links)
    while True:
        above = at.select(F.col("id").alias("up"), F.col("up").alias("_next"))
        further = stored(at.join(above, "up", "left").select("id", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("_moved")))
        at = further.select("id", "up")
        if further.where("_moved").isEmpty():
            return at.withColumnRenamed("up", "cluster")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _joined(keys: np.ndarray, starts: np.ndarray, size: np.ndarray, leaf: np.ndarray, n: np.ndarray, sim_th: float, tiers: tuple) -> np.ndarray:
    """For each signature the earlier one that it joins, or itself; as ``_most_similar``, for whole leaves in one task.

    Signatures stand by leaf and in their order there. ``keys`` from ``starts[s]`` to ``starts[s + 1]`` are the constants of
    signature s, rarest first, as numbers into ``n``, the messages that have each.
    """
    held = np.diff(starts)
    by_key = np.argsort(keys, kind="stable")
    owner = np.repeat(np.arange(len(held)), held)[by_key]
    first = np.searchsorted(keys[by_key], np.arange(len(n)))
    place = np.empty(len(keys), dtype=np.int64)
    place[by_key] = np.arange(len(keys))
    rank = np.zeros(len(n), dtype=np.int32)
    up = np.arange(len(held))
    leads = np.searchsorted(leaf, leaf) if sim_th <= 0 else None
    for s in range(len(held)):
        own = slice(starts[s], starts[s + 1])
        least = max(1, math.ceil(sim_th * size[s]))
        prefix, seen, best = held[s] - least + 1, 0, (0, 0, s)
        for high in tiers:
            if seen >= prefix or -best[0] >= held[s] - seen:
                break
            to = prefix if high is None else min(prefix, np.searchsorted(n[keys[own]], high, side="right"))
            asked = range(starts[s] + seen, starts[s] + to)
            seen = max(seen, to)
            # The lists of a constant's signatures, as far as they come before this one.
            met = [owner[first[keys[j]] : place[j]] for j in asked if first[keys[j]] < place[j]]
            if not met:
                continue
            met = np.unique(np.concatenate(met))
            rank[keys[own]] = np.arange(1, held[s] + 1)
            found = rank[keys[_ranges(starts[met], held[met])]]
            rank[keys[own]] = 0
            at = np.cumsum(held[met]) - held[met]
            common = np.add.reduceat(found > 0, at, dtype=np.int64)
            rarest = np.minimum.reduceat(np.where(found > 0, found, len(keys) + 1), at)
            top = np.lexsort((met, rarest, -common))[0]
            new = (-int(common[top]), int(rarest[top]), int(met[top]))
            best = min(best, new)
        if -best[0] >= least:
            up[s] = best[2]
        elif leads is not None:
            up[s] = leads[s]
    return up


def _clusters(sim_th: float, tiers: tuple) -> Callable[[pa.Table], pa.Table]:
    """Steps 2 to 4 for the messages of some whole leaves, given with ``leaf`` and the ``keys`` of their tokens (0: wildcard).

    Adds ``cluster`` and, in the row that names the cluster, its ``first`` line and the positions ``varies`` of its parameters.
    """

    def clusters(table: pa.Table) -> pa.Table:
        lists = table["keys"].combine_chunks()
        token, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        leaf, line = table["leaf"].to_numpy(), table["first_line"].to_numpy()
        begin = np.cumsum(size) - size
        _, key, n = np.unique(token, return_inverse=True, return_counts=True)
        constant = (token != 0) & (n[key] > 1)
        key, row = key[constant], np.repeat(np.arange(len(size)), size)[constant]
        key = key[np.lexsort((n[key], row))]  # rarest first, equal ones by position
        held = np.bincount(row, minlength=len(size))
        starts = np.cumsum(held) - held
        alike = np.flatnonzero(held >= sim_th * size)

        # Signatures: equal constants in one leaf.
        number: dict[tuple, int] = {}
        of = np.array([number.setdefault((leaf[r], key[starts[r] : starts[r] + held[r]].tobytes()), len(number)) for r in alike], dtype=np.int64)
        _, one, m = np.unique(of, return_index=True, return_counts=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, of, line[alike])
        one = alike[one]
        order = np.lexsort((least, -m, leaf[one]))
        one, least = one[order], least[order]
        ends = np.concatenate([[0], np.cumsum(held[one])])
        up = _joined(key[_ranges(starts[one], held[one])], ends, size[one], leaf[one], n, sim_th, tiers)
        for s in range(len(up)):
            up[s] = up[up[s]]  # the earlier one is at its root already
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        root = up[place[of]]
        cluster = line.copy()
        cluster[alike] = least[root]

        # Templates: positions where a message differs from the one that names its cluster.
        named = np.full(len(one), -1)
        heads = alike[cluster[alike] == line[alike]]
        named[root[cluster[alike] == line[alike]]] = heads
        head = np.arange(len(size))
        head[alike] = named[root]
        begins = line.copy()
        np.minimum.at(begins, head, line)
        others = np.flatnonzero(head != np.arange(len(size)))
        mine, theirs = _ranges(begin[others], size[others]), _ranges(begin[head[others]], size[others])
        apart = np.unique(theirs[token[mine] != token[theirs]])
        holder = np.searchsorted(begin, apart, side="right") - 1
        varies = [None] * len(size)
        for k in np.split(np.arange(len(apart)), np.flatnonzero(np.diff(holder)) + 1) if len(apart) else []:
            varies[holder[k[0]]] = (apart[k] - begin[holder[k[0]]]).tolist()
        is_head = head == np.arange(len(size))
        return (
            table.select(["masked", "n", "first_line"])
            .append_column("cluster", pa.array(cluster, pa.int64()))
            .append_column("first", pa.array(begins, pa.int64(), mask=~is_head))
            .append_column("varies", pa.array(varies, pa.list_(pa.int32())))
        )

    return clusters


def _clusters_within(placed: DataFrame, groups: int, sim_th: float) -> DataFrame:
    """(masked, n, first_line, cluster, first, varies): leaves meet in ``groups`` groups of whole ones, each in one task."""
    keys = _keys(lambda at, key: F.coalesce(key, F.lit(0).cast("long")))
    dealt = placed.select("masked", "n", "first_line", F.xxhash64("leaf").alias("_leaf"), "leaf", F.pmod(F.xxhash64("leaf"), F.lit(groups)).alias("_group"))
    # The text is shuffled, which is shorter than the hashes of its tokens; those are made after it.
    together = dealt.repartition("_group").withColumn("tokens", tokens(F.col("masked")))
    rows = together.select("_group", "masked", "n", "first_line", F.col("_leaf").alias("leaf"), keys.alias("keys"))
    schema = "masked string, n bigint, first_line bigint, cluster bigint, first bigint, varies array<int>"
    return rows.groupBy("_group").applyInArrow(_clusters(sim_th, TIERS), schema)


def _clusters_across(placed: DataFrame, sim_th: float) -> DataFrame:
    """(first_line, cluster, alone) of messages of leaves of any size, by joins over all tasks."""
    held = _constants(placed)
    name = F.xxhash64("leaf", "size", "items.key")
    signed = stored(held.withColumns({"signature": name, "alone": F.size("items") < F.lit(float(sim_th)) * F.col("size")}))
    alone = signed.where("alone").select("first_line", F.col("first_line").alias("cluster"), "alone")
    alike = signed.where("NOT alone")
    signatures = stored(
        alike.groupBy("signature")
        .agg(F.first("leaf").alias("leaf"), F.first("size").alias("size"), F.first("items").alias("items"), F.count(F.lit(1)).alias("m"), F.min("first_line").alias("id"))
    )
    roots = _roots(_most_similar(signatures, sim_th))
    named = stored(signatures.select("signature", "id").join(roots, "id", "left").select("signature", F.coalesce("cluster", "id").alias("cluster")))
    return alone.unionByName(alike.join(named, "signature").select("first_line", "cluster", "alone"))


def _final_templates(members: DataFrame) -> DataFrame:
    """(cluster, shown) of clusters that are not alone: the token where all messages agree, else the wildcard."""
    placed = members.where("NOT alone").select("cluster", F.posexplode_outer(tokens(F.col("masked"))).alias("_at", "_token"))
    agreed = placed.groupBy("cluster", "_at").agg(F.min("_token").alias("_low"), F.max("_token").alias("_high"))
    token = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.lit(WILDCARD))
    parts = agreed.groupBy("cluster").agg(
        F.sort_array(F.collect_list(F.struct("_at", token.alias("_token")))).alias("_parts")
    )
    return parts.select("cluster", F.concat_ws(" ", F.transform("_parts", lambda p: p["_token"])).alias("shown"))


def _shown() -> Column:
    """The template of a message whose cluster has no ``shown`` of its own: its tokens."""
    return F.coalesce("shown", F.array_join(tokens(F.col("masked")), " ")).alias("event_template")


def _mined(parsed: DataFrame, depth: int, sim_th: float, max_children: int) -> DataFrame:
    """Stored ``(masked, n, event_id, shown)``: ``shown`` is the template where that is not the message itself."""
    distinct = stored(parsed.where("masked IS NOT NULL").groupBy("masked").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first_line")))
    if not distinct.groupBy("first_line").count().where("count > 1").isEmpty():
        raise ValueError("line_id is not unique: two messages begin at one line")
    placed, leaf_tokens = leaves(distinct, depth, max_children)
    large = F.col("n_tokens") > LEAF_TOKENS
    seen = leaf_tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count_if(large).alias("large")).first()
    # A large leaf has LEAF_TOKENS tokens, so they are few.
    marks = F.broadcast(leaf_tokens.where(large).select("leaf")) if seen.large else None
    small = placed if marks is None else placed.join(marks, "leaf", "left_anti")
    members = stored(_clusters_within(small, 1 + seen.tokens // GROUP_TOKENS, sim_th))
    shape = F.array_join(F.transform(tokens(F.col("masked")), lambda t, at: F.when(F.array_contains("varies", at), F.lit(WILDCARD)).otherwise(t)), " ")
    heads = members.where("first IS NOT NULL").select("cluster", F.col("first").alias("first_line"), F.when(F.col("varies").isNotNull(), shape).alias("shown"))
    members = members.select("masked", "n", "cluster")
    if marks is not None:
        others = placed.join(marks, "leaf", "left_semi")
        others = stored(distinct.join(_clusters_across(others, sim_th), "first_line"))
        lines = others.groupBy("cluster").agg(F.min("first_line").alias("first_line"))
        heads = heads.unionByName(lines.join(_final_templates(others), "cluster", "left"))
        members = members.unionByName(others.select("masked", "n", "cluster"))
    named = templates.with_event_ids(stored(heads))
    # As many rows as templates, joined to distinct messages; AQE picks the strategy from its size.
    return stored(members.join(named.select("cluster", "event_id", "shown"), "cluster").select("masked", "n", "event_id", "shown"))


def mine_messages(parsed: DataFrame, depth: int = 4, sim_th: float = 0.4, max_children: int = 100) -> DataFrame:
    """Event of each distinct masked message: ``(masked, n, event_id, event_template)``.

    Lines are reduced to distinct messages first; all mining works on those. ``line_id`` must be unique.
    """
    return _mined(parsed, depth, sim_th, max_children).select("masked", "n", "event_id", _shown())


def mine(parsed: DataFrame, depth: int = 4, sim_th: float = 0.4, max_children: int = 100) -> DataFrame:
    """Add ``event_id`` and the final ``event_template`` to every line."""
    found = with_events(parsed, _mined(parsed, depth, sim_th, max_children))
    return found.select(*parsed.columns, "event_id", _shown())


def with_events(parsed: DataFrame, mined: DataFrame) -> DataFrame:
    """Look the events of mined messages up for every line."""
    return lookup(parsed, mined, "masked", "n", "line_id")
