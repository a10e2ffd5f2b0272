"""Prefix trie of conversations, its subtree sums by the Euler tour technique.

Every conversation c is rebuilt: the first h turns of its base conversation b = c - c % 5 (remainders are not
negative), then its own turns behind its first h, h = crc32(c) % 9. Each distinct sequence of the first d rebuilt
turns is a node of depth d; a node is known by its smallest member and its depth.

1. Turns, as digests without their texts, are sorted over the whole table and written in pieces of about
   PIECE_ROWS rows; a long conversation spans several. A piece is summed up by one row (what its last
   conversation adds to a chain of hashes, as an affine map), the rows are composed from piece to piece, and
   a second scan knows each turn's place and each prefix's hash.
2. Equal prefixes are added up to nodes (a partial aggregate first), nodes meet their parents by key, and
   siblings are linked in the order of their smallest members, again over sorted pieces.
3. Each node has an enter and an exit arc. enter(v) is followed by enter(first child) or exit(v), exit(v) by
   enter(next sibling) or exit(parent). The tour is list-ranked in two steps: within pieces of nodes that are
   sorted by smallest member, runs of following arcs become chains; the chains are ranked among each other
   by pointer jumping over written tables.
4. Leaves and savings stand as weights on enter arcs; a subtree's sums are the difference of the sums at its two arcs.

Member lists are joined in blocks (a node's ids of one Arrow batch), sorted by node and id, and hashed as a stream, so no list is held whole.

Results: turns are in the order of turn (null first), those of one number in the order of the SHA-256 digests of
their role and text; a null role or text is empty; repeated rows are turns of their own; rows without a conv_id belong
to no conversation; conversations without rebuilt turns are members of the root; an empty table has no nodes;
texts of any length are used whole; other columns are not read. Prefixes count as equal if 122 bits of hashes agree.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import checkpointed, discarded

#: Rows of a sorted piece; pieces grow beyond MOST_PIECES of them, as the driver holds a row for each.
PIECE_ROWS, MOST_PIECES = 50_000, 100_000
#: Conversations of a base group, and the most turns that one takes over is GROUP_TURNS - 1.
GROUP, GROUP_TURNS = 5, 9
#: The chain of hashes: s -> s * multiplier + digest + 1 modulo a prime, twice.
PRIME, MULTIPLIERS = 2**61 - 1, (0x1B873593CC9E2D51, 0x0F58D1C2E9B5A877)


def taken_over(conv: int) -> int:
    """How many turns of its base a conversation begins with (for a base, its own: none are replaced)."""
    return zlib.crc32(str(conv).encode()) % GROUP_TURNS if conv % GROUP else 0


def pieces_for(rows: int, piece_rows: int) -> int:
    return max(1, min(MOST_PIECES, -(-rows // piece_rows)))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, n_bytes of the text and two 60-bit halves of the digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("n_bytes"), half(1).alias("x"), half(16).alias("y"))


def sorted_turns(conversations: DataFrame, piece_rows: int) -> DataFrame:
    """The turns in order, in written pieces with their numbers of piece and row."""
    rows = turn_digests(conversations)
    order = ("conv_id", F.col("turn").asc_nulls_first(), "x", "y")
    spread = rows.repartitionByRange(pieces_for(rows.count(), piece_rows), *order).sortWithinPartitions(*order)
    return checkpointed(spread.select(F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("row"), "conv_id", "n_bytes", "x", "y"))


def whole_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces of a partition, one after another. A file of one row group is read whole and in order; anything else is an error."""
    held: list[pd.DataFrame] = []

    def joined() -> pd.DataFrame:
        piece = pd.concat(held, ignore_index=True)
        if not (np.diff(piece.row.to_numpy()) == 1).all() or piece.row.iloc[0] & ((1 << 33) - 1):
            raise ValueError("a sorted piece was not read in its order")
        return piece

    for pdf in batches:
        for number, part in pdf.groupby("piece", sort=False):
            if held and held[0].piece.iloc[0] != number:
                yield joined()
                held = []
            held.append(part)
    if held:
        yield joined()


def follow(state: tuple[int, int], x: int, y: int) -> tuple[int, int]:
    """The chain of hashes, one turn further."""
    return (state[0] * MULTIPLIERS[0] + x + 1) % PRIME, (state[1] * MULTIPLIERS[1] + y + 1) % PRIME


def composed(xs: list[int], ys: list[int]) -> tuple[tuple[int, int], tuple[int, int]]:
    """The affine map (factors, sums) of turns one after another."""
    u, v = 0, 0
    for x, y in zip(xs, ys, strict=True):
        u, v = follow((u, v), x, y)
    return tuple(pow(m, len(xs), PRIME) for m in MULTIPLIERS), (u, v)


def piece_summary(piece: pd.DataFrame) -> dict:
    """What the next piece has to know: the last conversation's first turns here, the map of its others, its base's turns here."""
    conv = piece.conv_id.to_numpy()
    last = int(conv[-1])
    start = int(np.searchsorted(conv, last))
    x, y, n = (piece[c].tolist() for c in ("x", "y", "n_bytes"))
    base = last - last % GROUP
    b, e = (int(np.searchsorted(conv, base, side)) for side in ("left", "right"))
    head, rest = slice(start, start + GROUP_TURNS - 1), slice(start + GROUP_TURNS - 1, None)
    factors, sums = composed(x[rest], y[rest])
    e = min(e, b + GROUP_TURNS - 1)
    return {
        "piece": int(piece.piece.iloc[0]), "first_conv": int(conv[0]), "last_conv": last, "n_rows": len(conv) - start,
        "head": [v for t in zip(x[head], y[head], strict=True) for v in t], "map": [*factors, *sums],
        "base": [v for t in zip(x[b:e], y[b:e], n[b:e], strict=True) for v in t],
    }


@dataclass
class Carry:
    """Where a piece begins: the conversation before it, its turns and rebuilt turns so far, its hash; its base's first turns."""

    conv: int | None = None
    turns: int = 0
    depth: int = 0
    state: tuple[int, int] = (0, 0)
    base: int | None = None
    base_turns: list[tuple[int, int, int]] = field(default_factory=list)
    #: The first conversation of the next piece.
    after: int | None = None


def carries(summaries: list[dict]) -> dict[int, Carry]:
    """For each piece, in order, where it begins."""
    out, carry = {}, Carry()
    ordered = sorted(summaries, key=lambda s: s["piece"])
    for s, following in zip(ordered, [*ordered, None][1:], strict=True):
        carry.after = following["first_conv"] if following else None
        out[s["piece"]] = carry
        last = s["last_conv"]
        base = last - last % GROUP
        here = list(zip(*[iter(s["base"])] * 3, strict=True))
        turns = ((carry.base_turns if carry.base == base else []) + here)[: GROUP_TURNS - 1]
        new = Carry(last, base=base, base_turns=turns)
        skip = taken_over(last)
        if carry.conv == last:
            new.turns, new.depth, new.state = carry.turns, carry.depth, carry.state
        else:
            for x, y, _ in turns[:skip]:
                new.state, new.depth = follow(new.state, x, y), new.depth + 1
        head = list(zip(*[iter(s["head"])] * 2, strict=True))
        for k, (x, y) in enumerate(head):
            if new.turns + k >= skip:
                new.state, new.depth = follow(new.state, x, y), new.depth + 1
        fu, fv, su, sv = s["map"]
        new.state = ((new.state[0] * fu + su) % PRIME, (new.state[1] * fv + sv) % PRIME)
        new.depth += s["n_rows"] - len(head)
        new.turns += s["n_rows"]
        carry = new
    return out


PREFIXES = "ka long, kb long, pa long, pb long, depth long, n_bytes long, conv_id long, member boolean"


def piece_prefixes(piece: pd.DataFrame, carry: Carry) -> pd.DataFrame:
    """A row for each rebuilt prefix that begins here (member), and one for each conversation that ends here (its whole)."""
    rows: list[tuple] = []
    conv, base, base_turns = carry.conv, carry.base, list(carry.base_turns)
    turns, depth, state, skip = carry.turns, carry.depth, carry.state, taken_over(carry.conv or 0)
    seen = False

    def further(x: int, y: int, n_bytes: int) -> None:
        nonlocal state, depth
        new = follow(state, x, y)
        depth += 1
        rows.append((*new, *state, depth, n_bytes, conv, True))
        state = new

    for c, x, y, n in zip(piece.conv_id.tolist(), piece.x.tolist(), piece.y.tolist(), piece.n_bytes.tolist(), strict=True):
        if c != conv:
            if seen:
                rows.append((*state, 0, 0, depth, 0, conv, False))
            conv, turns, depth, state, skip = c, 0, 0, (0, 0), taken_over(c)
            rows.append((0, 0, 0, 0, 0, 0, conv, True))
            if c - c % GROUP != base:
                base, base_turns = c - c % GROUP, []
            for t in base_turns[:skip]:
                further(*t)
        if c == base and turns < GROUP_TURNS - 1:
            base_turns.append((x, y, n))
        if turns >= skip:
            further(x, y, n)
        turns += 1
        seen = True
    if carry.after != conv:
        rows.append((*state, 0, 0, depth, 0, conv, False))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PREFIXES.split(", ")])


def rebuilt_prefixes(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Every prefix of every rebuilt conversation by its hash (ka, kb), with its parent's hash, and each conversation's whole."""
    turns = sorted_turns(conversations, piece_rows)

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in whole_pieces(batches):
            yield pd.DataFrame([piece_summary(piece)])

    kinds = "piece int, first_conv long, last_conv long, n_rows long, head array<long>, map array<long>, base array<long>"
    # one row for each piece, MOST_PIECES at most
    begins = carries([r.asDict() for r in turns.mapInPandas(sum_up, kinds).collect()])
    shared = conversations.sparkSession.sparkContext.broadcast(begins)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in whole_pieces(batches):
            yield piece_prefixes(piece, shared.value[int(piece.piece.iloc[0])])

    out = checkpointed(turns.mapInPandas(prefixes, PREFIXES))
    discarded(turns)
    return out


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, saved (of the node alone), ka and kb; the root has no parent."""
    summed = prefixes.filter("member").groupBy("ka", "kb", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("n_bytes").alias("n_bytes"))
    nodes = checkpointed(summed.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).drop("n_bytes"))
    root = nodes.filter("depth = 0").first()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "saved", "ka", "kb")
    # the root is the parent of all first turns and known; the others meet theirs
    top = nodes.filter("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None).cast("long"))).select(*columns)
    parents = nodes.filter("depth > 0").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    return top.unionByName(nodes.filter("depth > 1").join(parents, ["pa", "pb", "depth"]).select(*columns))


def with_siblings(nodes: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """nodes with first_child and n_children, and next_conv, the next sibling by smallest member (null: none)."""
    below = nodes.filter("depth > 0")
    pieces = pieces_for(below.count(), piece_rows)
    made = nodes.columns + ["next_conv", "linked", "piece", "edge"]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = TaskContext.get().partitionId()
        waiting = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.assign(piece=piece, edge=0)
            if waiting is None:
                pdf.loc[0, "edge"] = 1
            else:
                pdf = pd.concat([waiting, pdf], ignore_index=True)
            parent, depth, conv = (pdf[c].to_numpy() for c in ("parent_conv_id", "depth", "conv_id"))
            same = np.append((parent[1:] == parent[:-1]) & (depth[1:] == depth[:-1]), False)
            pdf = pdf.assign(next_conv=np.where(same, np.append(conv[1:], 0), 0), linked=same)
            waiting = pdf.iloc[-1:].drop(columns=["next_conv", "linked"])
            yield pdf.iloc[:-1][made]
        if waiting is not None:
            yield waiting.assign(edge=waiting.edge + 2, next_conv=0, linked=False)[made]

    order = ("parent_conv_id", "depth", "conv_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in below.schema) + ", next_conv long, linked boolean, piece int, edge int"
    linked = checkpointed(below.repartitionByRange(pieces, *order).sortWithinPartitions(*order).mapInPandas(link, kinds))
    # two rows a piece at most: its first, and its last, which the next piece's first may follow
    edges = linked.filter("edge > 0").select("piece", "edge", *order).orderBy("piece", "edge").collect()
    firsts = [r for r in edges if r.edge & 1]
    follows = {a.piece: b for a, b in zip([r for r in edges if r.edge & 2], firsts[1:], strict=False)}
    lasts = [(r.piece, b.conv_id) for r in edges if r.edge & 2 and (b := follows.get(r.piece)) and (b.parent_conv_id, b.depth) == (r.parent_conv_id, r.depth)]
    after = F.broadcast(nodes.sparkSession.createDataFrame(lasts, "piece int, after long"))
    following = F.when(F.col("linked"), F.col("next_conv")).when(F.col("edge") >= 2, F.col("after"))
    known = linked.join(after, "piece", "left").withColumn("next_conv", following).select(*nodes.columns, "next_conv")
    known = known.unionByName(nodes.filter("depth = 0").withColumn("next_conv", F.lit(None).cast("long")))
    children = below.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.min("conv_id").alias("first_child"), F.count("*").alias("n_children"))
    return known.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


#: Kinds of arcs; 0 stands for none.
ENTER, EXIT = 1, 2


def local_chains(succ: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For arcs with their local successors (-1: none): the first arc of each one's chain, its last, and the weights from each to the last."""
    here = np.arange(len(succ))
    nxt = np.where(succ < 0, here, succ)
    sums = np.where((succ < 0)[:, None], 0, weights)
    while (nxt != nxt[nxt]).any():
        sums = sums + sums[nxt]
        nxt = nxt[nxt]
    heads = np.ones(len(succ), bool)
    heads[succ[succ >= 0]] = False
    head_of = np.empty(len(succ), np.int64)
    head_of[nxt[heads]] = here[heads]
    return head_of[nxt], nxt, sums + weights[nxt]


NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ka", "kb")
ARCS = ", ".join(f"{c} long" for c in NODE_COLUMNS) + ", kind int, leaves long, saved long, in_conv long, in_depth long, in_kind int, out_conv long, out_depth long, out_kind int"


def piece_arcs(nodes: pd.DataFrame) -> pd.DataFrame:
    """The rows of a piece's nodes (kind 0), with what their two arcs say here, and of its chains (kind: that of the first arc).

    A node whose arcs are in one chain has its sums; else in_ and out_ name the chains whose sums have to be added
    and taken off. A chain has its own sums, and in_ names the arc behind its last.
    """
    n = len(nodes)
    conv, depth, parent, first, following, children = (nodes[c].to_numpy(np.int64) for c in ("conv_id", "depth", "parent_conv_id", "first_child", "next_conv", "n_children"))
    at = pd.MultiIndex.from_arrays([conv, depth])
    find = lambda c, d: at.get_indexer(pd.MultiIndex.from_arrays([c, d]))
    leaf, linked = children == 0, nodes.linked.to_numpy(bool)
    child, sibling, above = find(first, depth + 1), find(following, depth), find(parent, depth - 1)
    enter = np.where(leaf, np.arange(n) + n, child)
    leave = np.where(linked, sibling, np.where((above >= 0) & (depth > 0), above + n, -1))
    # names of the arcs that follow: conversation, depth and kind
    names = np.concatenate([
        np.column_stack([np.where(leaf, conv, first), np.where(leaf, depth, depth + 1), np.where(leaf, EXIT, ENTER)]),
        np.column_stack([np.where(linked, following, parent), np.where(linked, depth, depth - 1), np.where(linked, ENTER, np.where(depth > 0, EXIT, 0))]),
    ])
    weights = np.concatenate([np.column_stack([leaf, nodes.saved.to_numpy(np.int64)]), np.zeros((n, 2))]).astype(np.int64)
    head, last, sums = local_chains(np.concatenate([enter, leave]), weights)
    # what stands behind the head's sum when an arc's own is taken: local sum less that of the whole chain
    own = sums - sums[head]
    split = head[:n] != head[n:]
    difference = own[:n] - own[n:]
    arc_conv, arc_depth, arc_kind = np.tile(conv, 2), np.tile(depth, 2), np.repeat([ENTER, EXIT], n)
    tell = lambda arcs, on: {"conv": arc_conv[arcs], "depth": arc_depth[arcs], "kind": np.where(on, arc_kind[arcs], 0)}
    rows = nodes[["conv_id", "depth", "n_convs", "n_children", "ka", "kb"]].assign(parent_conv_id=parent, kind=0, leaves=difference[:, 0], saved=difference[:, 1])
    rows = rows.assign(**{f"in_{k}": v for k, v in tell(head[:n], split).items()}, **{f"out_{k}": v for k, v in tell(head[n:], split).items()})
    begins = np.flatnonzero(head == np.arange(2 * n))
    behind = names[last[begins]]
    chains = pd.DataFrame({"conv_id": arc_conv[begins], "depth": arc_depth[begins], "kind": arc_kind[begins], "leaves": sums[begins, 0], "saved": sums[begins, 1], "in_conv": behind[:, 0], "in_depth": behind[:, 1], "in_kind": behind[:, 2]})
    columns = [c.split()[0] for c in ARCS.split(", ")]
    return pd.concat([rows, chains.reindex(columns=columns, fill_value=0)], ignore_index=True)[columns]


def chain_sums(chains: DataFrame) -> DataFrame:
    """at, leaves and saved: the weights from each chain's first arc to the tour's end, by pointer jumping."""
    name = lambda conv, depth, kind: F.struct(F.col(conv).alias("conv"), F.col(depth).alias("depth"), F.col(kind).alias("kind"))
    now = checkpointed(chains.select(name("conv_id", "depth", "kind").alias("at"), F.when(F.col("in_kind") > 0, name("in_conv", "in_depth", "in_kind")).alias("next"), "leaves", "saved"))
    while not now.filter("next is not null").isEmpty():
        ahead = now.select(F.col("at").alias("next"), F.col("next").alias("further"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        jumped = now.filter("next is not null").join(ahead, "next").select("at", F.col("further").alias("next"), (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"))
        new = checkpointed(jumped.unionByName(now.filter("next is null")))
        discarded(now)
        now = new
    return now.drop("next")


def subtree_sums(nodes: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """NODE_COLUMNS, and n_leaves and saved_tokens of each node's subtree, from its two places in the Euler tour."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            yield piece_arcs(pd.concat(held, ignore_index=True))

    # no nulls, as pandas would hold the ids beside them as floats
    given = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("parent_conv_id", "first_child", "next_conv")}
    sent = nodes.withColumn("linked", F.col("next_conv").isNotNull()).withColumns(given)
    arcs = checkpointed(sent.repartitionByRange(pieces_for(nodes.count(), piece_rows), "conv_id", "depth").mapInPandas(run, ARCS))
    sums = chain_sums(arcs.filter("kind > 0"))
    found = arcs.filter("kind = 0")
    name = lambda way: F.struct(F.col(f"{way}_conv").alias("conv"), F.col(f"{way}_depth").alias("depth"), F.col(f"{way}_kind").alias("kind"))
    # joined only where the subtree leaves its chain
    split = found.filter("in_kind > 0").withColumn("in", name("in")).withColumn("out", name("out"))
    for way in ("in", "out"):
        split = split.join(sums.select(F.col("at").alias(way), F.col("leaves").alias(f"{way}_l"), F.col("saved").alias(f"{way}_s")), way)
    split = split.withColumn("leaves", F.expr("leaves + in_l - out_l")).withColumn("saved", F.expr("saved + in_s - out_s"))
    columns = [F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id") if c == "parent_conv_id" else c for c in NODE_COLUMNS]
    columns += [F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")]
    return found.filter("in_kind = 0").select(*columns).unionByName(split.select(*columns))


def end_hashes(prefixes: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """ka, kb and ends_sha256: the hash of the ids, ascending and comma-joined, of the conversations that end at a node."""
    ends = prefixes.filter("not member").select("ka", "kb", "conv_id")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            run = ((pdf.ka != pdf.ka.shift()) | (pdf.kb != pdf.kb.shift())).cumsum().to_numpy()
            made = pdf.assign(ids=pdf.conv_id.astype(str)).groupby(run, sort=False)
            yield made.agg(ka=("ka", "first"), kb=("kb", "first"), least=("conv_id", "first"), ids=("ids", ",".join)).reset_index(drop=True)

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, hashlib.sha256()
        for pdf in batches:
            out = []
            for ka, kb, ids in zip(pdf.ka, pdf.kb, pdf.ids, strict=True):
                if key != (ka, kb):
                    out += [(*key, digest.hexdigest())] if key else []
                    key, digest = (ka, kb), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pd.DataFrame(out, columns=["ka", "kb", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["ka", "kb", "ends_sha256"])

    order = ("ka", "kb", "conv_id")
    packed = ends.repartitionByRange(pieces_for(ends.count(), piece_rows), *order).sortWithinPartitions(*order).mapInPandas(blocks, "ka long, kb long, least long, ids string")
    return packed.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "least").mapInPandas(hashes, "ka long, kb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations."""
    prefixes = rebuilt_prefixes(conversations, piece_rows)
    nodes = checkpointed(trie_nodes(prefixes))
    sums = subtree_sums(checkpointed(with_siblings(nodes, piece_rows)), piece_rows)
    none: Column = F.lit(hashlib.sha256().hexdigest())
    found = sums.join(end_hashes(prefixes, piece_rows), ["ka", "kb"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
