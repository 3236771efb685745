"""A trie of conversation prefixes from composable fingerprints.

A sequence of turns has a fingerprint in a monoid: its length n and, modulo each of four primes, the value
v = e_1 + e_2 B + ... + e_n B^(n-1), with e from the digest of a turn. Two sequences one after the other have
(n, v) * (m, w) = (n + m, v + B^n w). So the turns of a conversation are fingerprinted in chunks, chunks are put together
by a scan over their products, and a rebuilt conversation (the head of its base, then its own later turns) gets all
its prefix fingerprints from stored products: no rebuilt text, and no turn's text twice, is ever made.

Prefixes with equal depth and fingerprint are one node. That is verified, not believed: turns with equal digests have
their texts compared, and all members of a node must agree on the digest of their last turn, a stored reference. As
equal fingerprints and equal last turns leave equal fingerprints one turn earlier, agreement at every depth is equality
of the whole prefixes. Where two different turns or prefixes meet, all is done anew with other digests.

Every node is named by its smallest member and its depth. If a conversation is the smallest member of a node, it is so
of all deeper nodes on its path; hence one depth a conversation, from which on it names its nodes, tells how it hangs in
the trie, and sums over subtrees become sums over members: no walk from level to level, whatever the depth.

Defined results: turns come in order of their numbers, null first; turns of one number in order of role, then text. Null
roles and texts are empty. Rows with a null conversation take no part, repeated rows are repeated turns. A base that
does not exist has no turns; one whose turns are fewer gives all of them. An empty table has no root. Further columns
are ignored. Texts are read whole, and compared where digests are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import settled
from fleetlens.llm.text import words_of
from fleetlens.plans.joins import join_null_safe

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525007, 1812433253, 1566083941)
#: Turn numbers that form a chunk of a conversation.
CHUNK = 64
#: Conversation numbers whose decimal texts are joined before they are hashed.
IDS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
#: Two columns hold two values of 31 bits each.
PRINT = ("f1", "f2")
LANES = range(len(PRIMES))


def _power(lane: int, exponent: Column) -> Column:
    """BASES[lane] to the power of a number from 0 on, modulo the lane's prime."""
    p, b = PRIMES[lane], BASES[lane]
    low = F.array(*[F.lit(pow(b, k, p)).cast("bigint") for k in range(CHUNK)])
    squares = F.array(*[F.lit(pow(b, CHUNK << k, p)).cast("bigint") for k in range(32)])
    high = F.aggregate(squares, F.struct(F.get(low, (exponent % CHUNK).cast("int")).alias("v"), F.floor(exponent / CHUNK).alias("rest")),
                       lambda a, s: F.struct(F.when(a["rest"] % 2 == 1, a["v"] * s % p).otherwise(a["v"]).alias("v"), F.floor(a["rest"] / 2).alias("rest")))
    return F.when(exponent < CHUNK, F.get(low, exponent.cast("int"))).otherwise(high["v"])


def _lane(prefix: str, lane: int) -> Column:
    """One of the four values packed into two columns."""
    packed = F.col(f"{prefix}{lane // 2 + 1}")
    return F.shiftright(packed, 31) if lane % 2 == 0 else packed.bitwiseAND((1 << 31) - 1)


def _packed(values: list[Column], prefix: str) -> list[Column]:
    return [(F.shiftleft(values[2 * k], 31).bitwiseOR(values[2 * k + 1])).alias(f"{prefix}{k + 1}") for k in range(2)]


def stored_turns(turns: DataFrame, seed: int) -> DataFrame:
    """conv_id, pos (from 1), n_words, digest (d1, d2) and the fingerprint (f1, f2) of the conversation up to each turn.

    A chunk is a span of turn numbers of one conversation. Ranks and running values are taken within chunks; a scan over
    the (length, value) products of a conversation's chunks says what lies before each of them.
    """
    rows = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / CHUNK).alias("chunk"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"),
                        *[F.xxhash64(F.lit(seed + k), "role", "text").alias(f"d{k + 1}") for k in range(2)])
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = rows.withColumn("k", F.row_number().over(inside).cast("bigint")).drop("turn", "role", "text")
    # a digest's halves are the elements of the four lanes
    element = [F.pmod(F.shiftrightunsigned(f"d{k // 2 + 1}", 32) if k % 2 == 0 else F.col(f"d{k // 2 + 1}").bitwiseAND((1 << 32) - 1), F.lit(PRIMES[k])) for k in LANES]
    terms = ranked.withColumns({f"t{k}": element[k] * _power(k, F.col("k") - 1) % PRIMES[k] for k in LANES})
    upto = Window.partitionBy("conv_id", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    local = terms.withColumns({f"s{k}": F.sum(f"t{k}").over(upto) % PRIMES[k] for k in LANES})

    # (n, v) of the chunks, and of all that lies before a chunk
    sums = terms.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"), *[(F.sum(f"t{k}") % PRIMES[k]).alias(f"v{k}") for k in LANES])
    earlier = Window.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("n0", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = placed.withColumns({f"w{k}": F.col(f"v{k}") * _power(k, F.col("n0")) % PRIMES[k] for k in LANES})
    placed = placed.select("conv_id", "chunk", "n0", *[(F.coalesce(F.sum(f"w{k}").over(earlier), F.lit(0)) % PRIMES[k]).alias(f"v0{k}") for k in LANES])
    whole = join_null_safe(local, placed, ["conv_id", "chunk"])
    value = [(F.col(f"v0{k}") + F.col(f"s{k}") * _power(k, F.col("n0"))) % PRIMES[k] for k in LANES]
    return whole.select("conv_id", (F.col("n0") + F.col("k")).alias("pos"), "n_words", "d1", "d2", *_packed(value, "f"))


def digests_agree(turns: DataFrame, seed: int) -> bool:
    """Whether turns of one digest are equal; of copies within a task, one is compared with those of other tasks."""
    both = F.struct("role", "text")
    groups = turns.groupBy(*[F.xxhash64(F.lit(seed + k), "role", "text").alias(f"d{k + 1}") for k in range(2)])
    return groups.agg((F.min(both) == F.max(both)).alias("same")).where("NOT same").isEmpty()


def rebuilt_prefixes(stored: DataFrame, modulus: int, head: Column) -> DataFrame:
    """conv_id, depth, fingerprint, digest and words of the last turn, words up to it, whether the conversation ends here,
    and the stored turn that stands there (turn_conv_id, turn_pos).

    `head` gives, from conv_id, how many turns are taken from the base; at most 3.
    """
    base = F.col("conv_id") - F.col("conv_id") % modulus
    # three turns of a base at most, and a base has `modulus` conversations at most on either side of zero
    first = F.array_sort(F.collect_list(F.when(F.col("pos") <= 3, F.struct("pos", "n_words", "d1", "d2", *PRINT))))
    convs = stored.groupBy("conv_id").agg(F.max("pos").alias("n"), first.alias("first"))
    convs = settled(convs.withColumns({"base": base, "h": head}), "trie-conversations")
    heads = convs.where(F.col("conv_id") == F.col("base")).select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    met = convs.join(heads, "base", "left")
    taken = F.coalesce(F.slice("base_first", 1, F.col("h")), F.array().cast(convs.schema["first"].dataType))
    met = met.select("conv_id", "base", "n", "h", taken.alias("head"), F.when(F.col("h") > 0, F.get("first", F.least("h", "n").cast("int") - 1)).alias("cut"))
    met = met.withColumns({"n_head": F.size("head"), "last": F.get("head", F.size("head") - 1)})
    words_before = F.aggregate("head", F.lit(0).cast("bigint"), lambda s, t: s + t["n_words"])
    length = F.col("n_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    info = met.select("conv_id", "base", "h", "head", "n_head", length.alias("length"), words_before.alias("head_words"),
                      *[F.coalesce(F.col(f"last.f{k}"), F.lit(0)).alias(f"p{k}") for k in (1, 2)],
                      *[F.coalesce(F.col(f"cut.f{k}"), F.lit(0)).alias(f"c{k}") for k in (1, 2)])

    zero = F.lit(0).cast("bigint")
    root = info.select("conv_id", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("d1"), zero.alias("d2"), zero.alias("n_words"),
                       (F.col("length") == 0).alias("ends"), F.lit(None).cast("bigint").alias("turn_conv_id"), F.lit(None).cast("bigint").alias("turn_pos"))
    heading = info.select("conv_id", "base", "length", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.f1", "t.f2", "t.d1", "t.d2", "t.n_words", (F.col("t.pos") == F.col("length")).alias("ends"),
        F.col("base").alias("turn_conv_id"), F.col("t.pos").alias("turn_pos"))
    own = stored.join(info.drop("head", "base", "head_words"), "conv_id").where(F.col("pos") > F.col("h"))

    def joined(k: int) -> Column:
        # head * suffix: the suffix loses the h turns before it and moves behind the head
        p = PRIMES[k]
        moved = F.element_at(F.array(*[F.lit(pow(BASES[k], -d, p)).cast("bigint") for d in range(4)]), (F.col("h") - F.col("n_head") + 1).cast("int"))
        return (_lane("p", k) + F.pmod(_lane("f", k) - _lane("c", k), F.lit(p)) * moved) % p

    depth = F.col("pos") - F.col("h") + F.col("n_head")
    tail = own.select("conv_id", depth.alias("depth"), *_packed([joined(k) for k in LANES], "f"), "d1", "d2", "n_words", (depth == F.col("length")).alias("ends"),
                      F.col("conv_id").alias("turn_conv_id"), F.col("pos").alias("turn_pos"))
    return root.unionAll(heading).unionAll(tail)


def _with_running_words(rows: DataFrame) -> DataFrame:
    """Adds `upto`, the words of a conversation's turns up to each depth, by chunks of depths."""
    cut = rows.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy("conv_id", "chunk").agg(F.sum("n_words").alias("words"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "chunk", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words0"))
    out = cut.withColumn("local", F.sum("n_words").over(inside)).join(before, ["conv_id", "chunk"])
    return out.select(*rows.columns, (F.col("local") + F.col("words0")).alias("upto"))


def _hash_ids(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each node's comma-joined ids; a node's pieces come one after the other, in order."""
    node, state, first = None, None, True
    for part in parts:
        done = []
        for depth, f1, f2, ids in zip(part["depth"], part["f1"], part["f2"], part["ids"]):
            if (depth, f1, f2) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state, first = (depth, f1, f2), hashlib.sha256(), True
            state.update(ids.encode() if first else b"," + ids.encode())
            first = False
        yield pd.DataFrame(done, columns=["depth", "f1", "f2", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "f1", "f2", "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """depth, f1, f2 and ends_sha256 of the nodes where conversations end.

    At most `IDS` ids become one text before the texts of a node meet in one task, which passes over them in order
    and holds one at a time: the hash of a sequence has no parallel form.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = rows.where("ends").groupBy("depth", *PRINT, F.floor(F.col("conv_id") / IDS).alias("piece")).agg(text.alias("ids"))
    dealt = pieces.repartition("depth", *PRINT).sortWithinPartitions("depth", *PRINT, "piece")
    return dealt.select("depth", *PRINT, "ids").mapInPandas(_hash_ids, "depth long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, modulus: int = 20, head: Column | None = None) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    stored turn that is its last one (turn_conv_id, turn_pos; null for the root).

    Conversation c begins with the first `head` turns of conversation c - c % `modulus` and goes on with its own turns
    after as many; by default crc32 of c in decimal, modulo 4. `saved_tokens` counts the words that a store of distinct
    prefixes does not repeat, over the subtree.
    """
    if head is None:
        head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    seed = 0
    while True:
        rows, nodes = _nodes(turns, modulus, head, seed)
        if digests_agree(turns, seed) and nodes.where("NOT same").isEmpty():
            return _measured(rows, nodes)
        seed += 2


def _nodes(turns: DataFrame, modulus: int, head: Column, seed: int) -> tuple[DataFrame, DataFrame]:
    stored = settled(stored_turns(turns, seed), "trie-turns")
    rows = settled(_with_running_words(rebuilt_prefixes(stored, modulus, head)), "trie-prefixes")
    last = F.struct("d1", "d2")
    nodes = rows.groupBy("depth", *PRINT).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), (F.min(last) == F.max(last)).alias("same"),
        F.min(F.struct("turn_conv_id", "turn_pos")).alias("turn"))
    return rows, settled(nodes, "trie-nodes")


def _measured(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    # from `opens` on, a conversation is the smallest member of the nodes on its path
    naming = nodes.groupBy("conv_id").agg(F.min("depth").alias("opens"))
    lengths = rows.where("ends").select("conv_id", F.col("depth").alias("length"))
    known = lengths.join(naming, "conv_id", "left").select("conv_id", "length", F.coalesce("opens", F.col("length") + 1).alias("opens"))

    # where a conversation leaves the nodes of smaller ones: its last shared prefix
    shared = rows.join(known, "conv_id").where(F.col("depth") == F.col("opens") - 1).select(
        "conv_id", "depth", *PRINT, F.col("upto").alias("shared_words"), (F.col("opens") <= F.col("length")).alias("branches"))
    shared = settled(shared, "trie-branches")
    # the root, which very many conversations leave, is known without a join; adaptive execution splits other hot nodes
    names = nodes.select("depth", *PRINT, F.col("conv_id").alias("parent_conv_id"))
    below = shared.where("branches")
    first = nodes.where("depth = 0").select(F.col("conv_id").alias("parent_conv_id"))
    branch = (below.where("depth > 0").join(names, ["depth", *PRINT]).select("conv_id", "depth", "parent_conv_id")
              .unionAll(below.where("depth = 0").select("conv_id", "depth").withColumn("parent_conv_id", first.scalar())))
    branch = settled(branch, "trie-parents")

    extra = branch.groupBy(F.col("parent_conv_id").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("n_branches"))
    facts = known.select("conv_id", "length").join(branch.select("conv_id", F.col("depth").alias("branch_depth"), "parent_conv_id"), "conv_id", "left")
    tree = nodes.join(facts, "conv_id").join(extra, ["conv_id", "depth"], "left")
    tree = tree.select("conv_id", "depth", *PRINT, "n_convs", "turn",
                       F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("branch_depth") + 1, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                       (F.coalesce("n_branches", F.lit(0)) + F.when(F.col("depth") < F.col("length"), 1).otherwise(0)).cast("bigint").alias("n_children"))
    tree = settled(tree, "trie-tree")

    # members carry what they add to each node above: a leaf that they name, and words that a smaller one has already
    leaf = tree.where("n_children = 0").select("conv_id", F.lit(1).alias("leaf"))
    adds = known.join(shared.select("conv_id", "shared_words"), "conv_id", "left").join(leaf, "conv_id", "left").select(
        "conv_id", "opens", F.coalesce("shared_words", F.lit(0)).alias("shared_words"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    saved = F.when(F.col("depth") < F.col("opens"), F.col("shared_words") - F.col("upto") + F.col("n_words")).otherwise(0)
    sums = rows.join(adds, "conv_id").groupBy("depth", *PRINT).agg(F.sum("leaf").cast("bigint").alias("n_leaves"), F.sum(saved).cast("bigint").alias("saved_tokens"))
    out = tree.join(sums, ["depth", *PRINT]).join(end_digests(rows), ["depth", *PRINT], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "turn.turn_conv_id", "turn.turn_pos")
