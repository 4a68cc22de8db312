"""Jaccard join on word n-grams, with token-combination prefixes.

A document is the set of its distinct n-grams ("tokens" below, 64-bit
hashes). Equal sets become one node. Tokens have one order for all documents:
rare ones by hash, then frequent ones by hash. A document that may miss
``slack`` of its tokens and still be a link's end indexes the shortest prefix
of its ordered tokens from which so many tokens can't remove every signature:

- a rare token is a signature by itself;
- frequent tokens fall into groups, and each pair of one group is a signature,
  so a group with c tokens in the prefix withstands c - 1 losses. The prefix is
  extended accordingly. The number of groups follows the document's size (by
  powers of two; a document near the lower end of its power is indexed for the
  one below as well), which keeps the pairs in proportion to the prefix.

Which tokens count as frequent decides only the cost: any such set gives the
same links. It is the most frequent tokens of all prefixes, at most
``frequent_most``, so its size doesn't follow the corpus.

The prefix is longer by ``MATCHES`` - 1 than would do for one shared signature,
so a link's ends share ``MATCHES`` of them. Documents that do are candidates if
their sizes and the first shared signature's position allow the overlap. They
are verified on their whole sets in rounds: ``HEADS`` nodes of each list, the
least by as many hashes, against the others; and again, with other heads,
while lists hold many pairs that no component joins yet and a round still
joins a good part of them. A pair within a component needs no check:
components are exact without it.

What then stands in lists with several components is compared block against
block: nodes of one least signature make blocks, blocks that share enough
lists meet, and one Arrow group compares the sets of such a pair of blocks. It
puts out the links that join components, at most one fewer than there are
nodes, never a row for each meeting. So a family of near copies about the
threshold costs comparisons in numpy but no rows, and none is left out.

Defined cases: null and empty texts, and texts without a word, have an empty
set and link with nothing; shorter texts than n words have one token; equal
texts link; ids may repeat or be null (such rows take part by their text);
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, shingle_hashes, tidy, words_of, written
from .components import connected_components
from .tokens import GROUP_CHARS, in_groups

_SLOT_BITS = 22
#: The most slots (a power of two) by which nodes are told whose sets are wanted.
_NODE_SLOT_BITS = 26
#: Signatures that a candidate pair shares.
MATCHES = 3
#: Nodes of each list that meet all its others in the first pass.
HEADS = 8
#: Another round of heads pays while the pairs without a common component are so many times the rows of their lists,
#: and while a round leaves at most that share of them.
WORTH, LEFT = 8, 0.75
#: Nodes of a block, and nodes whose sets are held together when pairs are verified.
BLOCK_NODES, PLACE_NODES = 256, 1000
#: Tokens of a block, and of the blocks that are held together.
BLOCK_TOKENS, PLACE_TOKENS = 1 << 20, 1 << 22


def token_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct n-grams of each text's words, ASCII capitals lowered."""
    out = []
    for tokens in (shingle_hashes(words, n) for words in words_of(texts, lower=True)):
        tokens.sort()
        out.append(tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if len(tokens) > 1 else tokens)
    return out


def node_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def slack(n: int, percent: int) -> int:
    """Tokens of ``n`` that a link's end may lack in its partner."""
    return n - -(-percent * n // 100)


def groups_at(level: int, percent: int) -> int:
    return max(1, (2**level * (100 - percent)) // 200)


@dataclass
class Frequent:
    """Which tokens count as frequent: those listed (sorted), and those in the marked slots."""

    tokens: np.ndarray
    slots: np.ndarray

    def of(self, tokens: np.ndarray) -> np.ndarray:
        often = self.slots[(tokens >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
        if len(self.tokens):
            often |= self.tokens[np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)] == tokens
        return often


def signatures(tokens: np.ndarray, frequent: Frequent, percent: int, matches: int = MATCHES) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a sorted token set; for each, the most tokens that a partner can
    share which has this signature as the first one in common; and how many
    signatures a link's ends share at least, ``matches`` but for the smallest sets.
    """
    n = len(tokens)
    lost = slack(n, percent)
    sure = min(matches, n - lost - 1)
    if sure < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    need = lost + sure
    often = frequent.of(tokens)
    rare = tokens[~often]
    singles = rare[:need]
    sigs, most = [singles], [n - np.arange(len(singles))]
    if len(rare) < need:
        common = tokens[often]
        level = n.bit_length() - 1
        levels = [level] + [level - 1] * (n * percent < 100 * 2**level)
        for lev in levels:
            g = (mix64(common) % np.uint64(groups_at(lev, percent))).astype(np.int64)
            order = np.argsort(g, kind="stable")
            first = np.concatenate([[True], g[order][1:] != g[order][:-1]])
            repeat = np.ones(len(common), bool)
            repeat[order[first]] = False  # the first token of each group withstands no loss
            enough = np.flatnonzero(np.cumsum(repeat) >= need - len(rare))
            end = enough[0] + 1 if len(enough) else len(common)
            others = np.cumsum(~repeat)  # groups begun up to here, with this token's own
            by_group = order[order < end]
            cuts = np.flatnonzero(np.diff(g[by_group])) + 1
            pairs = []
            for members in np.split(by_group, cuts):
                if len(members) > 1:
                    a, b = np.triu_indices(len(members), 1)
                    pairs.append((members[a], members[b]))
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs))
                o = np.lexsort((b, a))
                a, b = a[o], b[o]
                sigs.append(mix64(common[a] * np.uint64(0x9E3779B97F4A7C15) + mix64(common[b] + np.uint64(lev + 1))))
                most.append(n - len(rare) - a + others[a] - 1)
    return np.concatenate(sigs), np.concatenate(most), sure


def _each(batches, n: int, emit):
    """What ``emit(batch, [(key, tokens, whether the task had this set before)])`` yields for parts of the batches."""
    seen: set[bytes] = set()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        for part in in_groups(texts, GROUP_CHARS):
            rows = []
            for tokens in token_sets(texts[part], n):
                key = node_key(tokens) if len(tokens) else None
                rows.append((key, tokens, key in seen))
                if key is not None:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
            yield from emit(batch.slice(part.start, part.stop - part.start), rows)


def _sets(docs: DataFrame, n: int, emit, schema: str) -> DataFrame:
    return docs.mapInArrow(tidy(lambda batches: _each(batches, n, emit)), schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def frequent_tokens(docs: DataFrame, n: int, percent: int, least: int, most: int) -> "Frequent":
    """Tokens in more than ``least`` prefixes, the ``most`` most frequent of them; and the slots
    (of a fixed number, by hash) of tokens that are frequent anywhere in the texts.

    A task counts all its tokens by slot and reports the slots that stand out;
    a token that is common in the corpus stands out in the tasks that hold it.
    """

    def emit(batch, rows):
        sets = [t for _, t, again in rows if len(t) > 1 and not again]
        if sets:
            prefixes = np.concatenate([t[: slack(len(t), percent) + 1] for t in sets])
            yield np.concatenate(sets), prefixes

    def run(batches):
        counts, total = np.zeros(1 << _SLOT_BITS, np.uint32), 0
        for tokens, prefixes in _each(batches, n, emit):
            np.add.at(counts, (tokens >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), np.uint32(1))
            total += len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(prefixes), bool)), _signed(prefixes), pa.array(np.ones(len(prefixes), np.int64))], names=["is_slot", "key", "c"])
        slots = np.flatnonzero(counts >= 8 + 4 * (total >> _SLOT_BITS))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(slots), bool)), pa.array(slots), pa.array(counts[slots].astype(np.int64))], names=["is_slot", "key", "c"])

    found = docs.select("text").mapInArrow(tidy(run), "is_slot boolean, key long, c long").groupBy("is_slot", "key").agg(F.sum("c").alias("c")).filter(F.col("c") > least)
    found = written(found, "frequent")
    top = found.filter("not is_slot").orderBy(F.desc("c"), "key").limit(most).select("key").toArrow()
    slots = np.zeros(1 << _SLOT_BITS, bool)
    slots[found.filter("is_slot").filter(F.col("c") > 4 * least).select("key").toArrow().column(0).to_numpy()] = True
    return Frequent(np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64)), slots)


def _postings(docs: DataFrame, n: int, percent: int, frequent: Frequent) -> DataFrame:
    def emit(batch, rows):
        sigs, most, keys, sizes, counts = [], [], [], [], []
        for key, tokens, again in rows:
            if key is None or again:
                continue
            s, m, sure = signatures(tokens, frequent, percent)
            sigs.append(s)
            most.append(m)
            keys.append(key)
            sizes.append(len(tokens) << 2 | sure)
            counts.append(len(s))
        if keys:
            which = np.repeat(np.arange(len(keys)), counts)
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(sigs)), pa.array(keys, pa.binary()).take(pa.array(which)), pa.array((np.array(sizes, np.int64)[which] << 32) | np.concatenate(most))], names=["sig", "node", "nq"])

    return _sets(docs.select("text"), n, emit, "sig long, node binary, nq long")


def _slot(node, bits: int):
    return F.shiftright(F.conv(F.hex(F.substring(node, 1, 4)), 16, 10).cast("long"), 32 - bits)


def _members(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, node and n of each document."""

    def emit(batch, rows):
        keys = [key for key, _, _ in rows]
        sizes = [len(t) for _, t, _ in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "text_key", "node", "n"])

    return _sets(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), n, emit, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, node binary, n long")


def _whole_sets(docs: DataFrame, n: int, nodes: DataFrame) -> DataFrame:
    """node and tokens, for ``nodes`` (node, distinct) and a few others, whose hashes fall into the same slots.

    The slots go to the driver as the words of a bitmap, at most 2**20 of them; beyond some ten million
    nodes ever more sets travel that nobody wants, at worst all, once.
    """
    bits = min(_NODE_SLOT_BITS, max(16, (64 * nodes.count()).bit_length()))
    slot = _slot(F.col("node"), bits)
    words = nodes.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 AS int)))").alias("m")).toArrow()
    wanted = np.zeros(1 << (bits - 5), np.uint32)
    wanted[words.column("w").to_numpy()] = words.column("m").to_numpy().astype(np.uint32)

    def is_wanted(key: bytes) -> bool:
        at = int.from_bytes(key[:4], "big") >> (32 - bits)
        return bool(wanted[at >> 5] >> np.uint32(at & 31) & np.uint32(1))

    def emit(batch, rows):
        found = [(key, np.sort(t.view(np.int64))) for key, t, again in rows if key is not None and not again and is_wanted(key)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=["node", "tokens"])

    return _sets(docs.select("text"), n, emit, "node binary, tokens array<long>").groupBy("node").agg(F.first("tokens").alias("tokens"))


def _near(percent: int, matches: int = MATCHES):
    """Condition on aliases x and y that the first ``matches`` signatures of a link meet: the i-th one
    still has the whole overlap but i - 1 tokens before it."""
    size = (F.col("x.n") + F.col("y.n")) * percent
    return (F.least("x.n", "y.n") * (100 + percent) >= size) & ((F.least("x.q", "y.q") + matches - 1) * (100 + percent) >= size)


def _candidates(joined: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v), structs of node and block, of ``joined`` (aliases x and y) that share enough signatures and can have the overlap."""
    one, other = (F.struct(f"{t}.node", f"{t}.b") for t in "xy")
    pairs = joined.groupBy(F.least(one, other).alias("u"), F.greatest(one, other).alias("v"))
    pairs = pairs.agg(F.count("*").alias("c"), F.max(F.least("x.q", "y.q")).alias("q"), F.first(F.least("x.sure", "y.sure")).alias("sure"), F.first((F.col("x.n") + F.col("y.n")) * percent).alias("size"))
    return pairs.filter((F.col("c") >= F.col("sure")) & (F.col("q") * (100 + percent) >= F.col("size"))).select("u", "v")


def _sides(joined: DataFrame) -> DataFrame:
    return joined.select(*(F.struct(f"{t}.node", f"{t}.n", f"{t}.sure", f"{t}.q", f"{t}.b").alias(t) for t in "xy"))


def _with_blocks(lists: DataFrame) -> DataFrame:
    """``lists`` with b, the node's block: nodes of one least signature, dealt to blocks of about ``BLOCK_NODES``."""
    least = lists.groupBy("node").agg(F.min("sig").alias("key"))
    crowd = least.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_NODES).alias("parts"))
    block = least.join(crowd, "key").select("node", F.xxhash64("key", F.pmod(F.xxhash64("node"), "parts")).alias("b"))
    return lists.join(block, "node")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The links among ``pairs``, by their whole sets.

    A pair goes where its two blocks meet, and a set is sent once to each such
    place, not once for each of its pairs.
    """
    placed = written(pairs.select("u.node", F.col("v.node").alias("other"), F.xxhash64("u.b", "v.b").alias("place")).select(F.col("node").alias("u"), F.col("other").alias("v"), "place"), "placed")
    ends = placed.select("place", F.col("u").alias("node")).unionByName(placed.select("place", F.col("v").alias("node")))
    buckets = ends.distinct().count() // PLACE_NODES + 1
    at = F.pmod(F.col("place"), F.lit(buckets)).cast("int")
    sets = written(_whole_sets(docs, n, ends.select("node").distinct()), "sets")
    sent = ends.select(at.alias("at"), "node").distinct().join(sets, "node")

    def check(pair: pa.Table, found: pa.Table):
        tokens = found.column("tokens").combine_chunks()
        edges, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        where = {k: i for i, k in enumerate(found.column("node").to_pylist())}
        us, vs = pair.column("u").to_pylist(), pair.column("v").to_pylist()
        linked = []
        for u, v in zip(us, vs):
            i, j = where[u], where[v]
            a, b = flat[edges[i] : edges[i + 1]], flat[edges[j] : edges[j + 1]]
            if len(a) > len(b):
                a, b = b, a
            k = np.searchsorted(b, a)
            shared = int((b[np.minimum(k, len(b) - 1)] == a).sum())
            linked.append(100 * shared >= percent * (len(a) + len(b) - shared))
        return pair.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return placed.select(at.alias("at"), "u", "v").groupBy("at").cogroup(sent.groupBy("at")).applyInArrow(check, "u binary, v binary")


def _heads(lists: DataFrame, seed: int) -> DataFrame:
    """The ``HEADS`` nodes of each list that as many hashes choose, in the form of ``lists``."""
    member = F.struct(*(c for c in lists.columns if c != "sig"))
    chosen = lists.groupBy("sig").agg(*(F.min(F.struct(F.xxhash64("node", F.lit(seed + r)).alias("h"), member.alias("m"))).alias(f"h{r}") for r in range(HEADS)))
    return chosen.select("sig", F.explode(F.array_distinct(F.array(*(F.col(f"h{r}.m") for r in range(HEADS))))).alias("m")).select("sig", "m.*")


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of ``lists`` whose list holds several labels, with the node's label (of a node without links, itself)."""
    rows = lists.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rows.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a != z").select("sig")
    return written(rows.join(several, "sig", "left_semi"), "mixed")


def _open_pairs(labelled: DataFrame) -> tuple[int, int]:
    """How many pairs of nodes of different labels the lists hold, and how many rows."""
    each = labelled.groupBy("sig", "label").agg(F.count("*").alias("m"))
    lists = each.groupBy("sig").agg(F.sum("m").alias("c"), F.sum(F.col("m").cast("double") * F.col("m")).alias("same"))
    r = lists.agg(F.sum((F.col("c").cast("double") * F.col("c") - F.col("same")) / 2), F.sum("c")).first()
    return int(r[0] or 0), int(r[1] or 0)


def _in_blocks(labelled: DataFrame, percent: int) -> DataFrame:
    """node, n, label, band (of sizes) and b, its block: nodes of one least signature and band, of one
    label where this fills blocks by itself, dealt to blocks of about ``BLOCK_NODES`` and ``BLOCK_TOKENS``."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)))).cast("int")
    nodes = labelled.groupBy("node").agg(F.min("sig").alias("key"), F.first("label").alias("label"), F.first("n").alias("n")).withColumn("band", band)
    own = nodes.groupBy("key", "band", "label").agg(F.count("*").alias("m")).select("key", "band", "label", F.when(F.col("m") >= BLOCK_NODES, F.col("label")).alias("own"))
    nodes = nodes.join(own, ["key", "band", "label"])
    group = ["key", "band", F.coalesce("own", F.lit(b"")).alias("own")]
    crowd = nodes.select(*group, "n").groupBy("key", "band", "own").agg(F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_TOKENS)).alias("parts"))
    dealt = nodes.withColumn("own", group[2]).join(crowd, ["key", "band", "own"])
    return dealt.select("node", "n", "label", "band", F.xxhash64("key", "band", "own", F.pmod(F.xxhash64("node"), "parts")).alias("b"))


def _block_pairs(labelled: DataFrame, nodes: DataFrame, percent: int, matches: int = MATCHES) -> DataFrame:
    """Pairs (x, y) of blocks that may hold a link: they share enough lists, their sizes and places in these
    lists allow the overlap, and there is more than one label."""
    rows = labelled.select("sig", "node", "n", "sure", "q", "label").join(nodes.select("node", "band", "b"), "node")
    rows = rows.groupBy("sig", "b", "band").agg(F.min("n").alias("n"), F.max("q").alias("q"), F.min("sure").alias("sure"), F.min("label").alias("a"), F.max("label").alias("z"))
    x = rows.withColumn("to", F.explode(F.sequence("band", F.col("band") + 2))).alias("x")
    y = rows.alias("y")
    ordered = (F.col("x.band") < F.col("y.band")) | (F.col("x.b") <= F.col("y.b"))
    several = (F.least("x.a", "y.a") != F.greatest("x.z", "y.z"))
    place = (F.least("x.q", "y.q") + matches - 1) * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.to") == F.col("y.band")) & ordered & several & place)
    pairs = met.groupBy(F.col("x.b").alias("x"), F.col("y.b").alias("y")).agg(F.count("*").alias("c"), F.min(F.least("x.sure", "y.sure")).alias("sure"))
    return pairs.filter("c >= sure").select("x", "y")


def links_between(one: tuple, other: tuple, state: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the sets of two blocks, (rows, token numbers, starts and ends of the rows) each, that join
    components: ``state`` holds the component of every row and is brought up to date."""
    rows, flat, starts, ends = other
    sizes = ends - starts
    present = np.zeros(max(int(one[1].max(initial=0)), int(flat.max(initial=0))) + 1, bool)
    found = []
    for i, s, e in zip(one[0], one[2], one[3]):
        apart = state[rows] != state[i]
        if not apart.any():
            continue
        mine = one[1][s:e]
        present[mine] = True
        shared = np.add.reduceat(present[flat], starts, dtype=np.int64)
        present[mine] = False
        for j in rows[apart & (100 * shared >= percent * (len(mine) + sizes - shared))]:
            if state[j] != state[i]:
                found.append((int(i), int(j)))
                state[state == state[j]] = state[i]
    return found


def _linked_blocks(labelled: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links that join the components of ``labelled`` as all links of its lists would."""
    nodes = written(_in_blocks(labelled, percent), "nodes")
    pairs = written(_block_pairs(labelled, nodes, percent), "block-pairs")
    blocks = nodes.groupBy("b").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    ends = pairs.select(F.xxhash64("x", "y").alias("place"), "x", "y").select("place", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))
    sums = ends.join(blocks, "b").agg(F.sum("m"), F.sum("t")).first()
    buckets = max((sums[0] or 0) // PLACE_NODES, (sums[1] or 0) // PLACE_TOKENS) + 1
    at = F.pmod(F.col("place"), F.lit(buckets)).cast("int")
    asked = ends.select(at.alias("at"), "b").distinct()
    wanted = nodes.join(asked.select("b").distinct(), "b", "left_semi").select("node", "b", "label")
    sets = written(wanted.join(_whole_sets(docs, n, wanted.select("node")), "node"), "block-sets")
    sent = asked.join(sets, "b").select("at", "b", "node", "label", "tokens")

    def compare(pair: pa.Table, found: pa.Table):
        column = found.column("tokens").combine_chunks()
        edges, flat = column.offsets.to_numpy(), np.unique(column.values.to_numpy(), return_inverse=True)[1]
        state = np.unique(np.array(found.column("label").to_pylist(), object), return_inverse=True)[1]
        block = found.column("b").to_numpy()
        order = np.argsort(block, kind="stable")
        names, first = np.unique(block[order], return_index=True)
        parts = dict(zip(names.tolist(), np.split(order, first[1:])))

        def part(name):
            rows = parts[name]
            lengths = (edges[1:] - edges[:-1])[rows]
            ends = np.cumsum(lengths)
            return rows, np.concatenate([flat[edges[r] : edges[r + 1]] for r in rows]), ends - lengths, ends

        made = {name: part(name) for name in parts}
        links = [x for a, b in zip(pair.column("x").to_pylist(), pair.column("y").to_pylist()) for x in links_between(made[a], made[b], state, percent)]
        node = found.column("node").to_pylist()
        return pa.table({"u": pa.array([node[i] for i, _ in links], pa.binary()), "v": pa.array([node[j] for _, j in links], pa.binary())})

    asks = pairs.select(F.xxhash64("x", "y").alias("place"), "x", "y").select(at.alias("at"), "x", "y")
    return asks.groupBy("at").cogroup(sent.groupBy("at")).applyInArrow(compare, "u binary, v binary")


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, frequent_least: int = 16, frequent_most: int = 2**18) -> DataFrame:
    """doc_id, text_key (of the text), n_shingles and root (the component's key; null for an empty set), one row for each document.

    Two documents link when 100 * intersection >= ``percent`` * union of their n-gram sets.
    """
    frequent = frequent_tokens(docs, n, percent, frequent_least, frequent_most)
    together = _postings(docs, n, percent, frequent).repartition("sig").dropDuplicates(["sig", "node"])
    lists = together.withColumn("c", F.count("*").over(Window.partitionBy("sig"))).filter("c > 1")
    lists = lists.select("sig", "node", F.shiftright("nq", 34).alias("n"), F.shiftright("nq", 32).bitwiseAND(F.lit(3)).alias("sure"), F.col("nq").bitwiseAND(F.lit(2**32 - 1)).alias("q"), "c")
    lists = written(_with_blocks(written(lists, "lists")), "blocks")

    long_, short = lists.filter(F.col("c") > HEADS), lists.filter(F.col("c") <= HEADS)
    met = None
    for rows, others, once in ((long_, _heads(long_, 0), F.col("x.node") != F.col("y.node")), (short, short, F.col("x.node") < F.col("y.node"))):
        some = _sides(rows.alias("x").join(others.alias("y"), (F.col("x.sig") == F.col("y.sig")) & once & _near(percent)))
        met = some if met is None else met.unionByName(some)
    links = written(_verified(_candidates(met, percent), docs, n, percent), "links")

    turn, left = 0, float("inf")
    while True:
        label = written(connected_components(links), "labels")
        labelled = _labelled(lists, label.withColumnRenamed("root", "label"))
        pairs, rows = _open_pairs(labelled)
        if pairs <= WORTH * HEADS * rows or pairs > LEFT * left:
            break
        turn, left = turn + 1, pairs
        heads = _heads(labelled.filter(F.col("c") > HEADS), turn * HEADS)
        some = labelled.alias("x").join(heads.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") != F.col("y.label")) & _near(percent))
        new = _verified(_candidates(_sides(some), percent), docs, n, percent)
        links = written(label.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new), "links")
    # Of a component, a label row for each node stands for its links.
    roots = label
    if pairs:
        last = _linked_blocks(labelled, docs, n, percent)
        roots = written(connected_components(label.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(last)), "roots")
    whole = _members(docs, n).join(roots, "node", "left")
    return whole.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))


def ngram_groups(docs: DataFrame, n: int = 4, percent: int = 85, **more) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach."""
    found = written(ngram_components(docs, n, percent, **more), "components")
    least = found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80, **more) -> DataFrame:
    """The rows of ``docs`` without those that link, directly or not, to a row that stays.

    Of each component stays the row with the least doc_id (null last), of rows that are alike one. Empty texts all stay.
    """
    found = written(ngram_components(docs, n, percent, **more), "components")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    stay = found.filter("root is not null").groupBy("root").agg(F.min(row).alias("r")).select(F.col("r.doc_id").alias("id"), F.col("r.text_key").alias("key"))
    each = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"), F.max(F.col("root").isNull()).alias("empty"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    stay = each.filter("not empty").join(stay, same, "left_semi").unionByName(each.filter("empty").withColumn("copies", F.lit(1).cast("long")))
    stay = written(stay.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "copies"), "stay")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))
    kept = keyed.join(stay, same).select("row", "doc_id", "text_key", "copies")
    again = kept.filter("copies > 1").dropDuplicates(["doc_id", "text_key"])
    return kept.filter("copies = 1").unionByName(again).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
