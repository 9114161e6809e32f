"""Exact n-gram Jaccard join with a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import RollingHash, components, mixed, slices
from newsloom.runtime import BROADCAST_IDS, settle, small, small_if_counted

WORDS, PERCENT = 5, 75
# Bytes of texts hashed at once: a task holds some fifty times as much while it hashes.
SLICE = 1 << 19
# Shingles of different sets counted at once in a task, and how often one must be met to
# count as frequent.
COUNTED, FREQUENT = 2_000_000, 2
# Frequent shingles that go last in the order of prefixes. Any order gives whole
# results, so a longer list would only save candidates.
LAST_TOKENS = 1_000_000
# Leading bits of shingles that deal them into arrays, at least; more in larger tables. Shingles
# of a task that are dealt at once.
HEAD_BITS, DEALT = 8, 1_000_000
# Members of a group whose union is stored, and rows of a bucket that finds families.
GROUP_SETS, FAMILY_SETS = 64, 256
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Shingler:
    """Distinct word shingles of texts as 64-bit hashes."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.rolling = RollingHash()

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's shingles; none without words.

        Words are runs without ASCII white space, A-Z in lower case. A text with fewer
        words than a shingle is one shingle. A hash runs over the words' bytes with one
        blank between them, all positions of a slice at once.
        """
        plain = [b" ".join((t or b"").lower().split()) for t in texts]
        buffer = np.frombuffer(b"\n".join([*plain, b""]), np.uint8)
        self.rolling.read(buffer)
        begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in plain])]).astype(np.int64)
        gaps = np.flatnonzero((buffer == 32) | (buffer == 10))  # one after each word, or after an empty text
        at = np.searchsorted(gaps, begins)
        found = []
        for text, first, a, b in zip(plain, begins.tolist(), at.tolist(), at[1:].tolist()):
            if not text:
                found.append(np.zeros(0, np.uint64))
                continue
            ends = gaps[a:b]
            starts = np.concatenate([[first], ends[:-1] + 1])
            if len(ends) > self.words:
                starts, ends = starts[: 1 - self.words], ends[self.words - 1 :]
            else:
                starts, ends = starts[:1], ends[-1:]
            hashes = np.sort(self.rolling.of(starts, ends))
            found.append(hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])])
        return found


def _binary(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _long(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def describe_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """A row for each document, and rows of frequent shingles with their counts.

    ``doc_id, n, set_id, keys``: equal sets have equal ``set_id``; ``keys`` are the
    least hashes of the set under two orders. Rows with ``token`` are the counts.
    """
    schema = "doc_id long, n long, set_id long, keys array<long>, token long, met long"
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("token", pa.int64()), ("met", pa.int64())]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, count = Shingler(words), [], 0
        names: set[int] = set()

        def frequent() -> pa.RecordBatch:
            tokens, met = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            often = met >= FREQUENT
            none = [None] * int(often.sum())
            values = [none, none, none, none, _long(tokens[often]), met[often]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, kinds)], names=[n for n, _ in kinds])

        for batch in slices(batches, "text", SLICE):
            sets = shingler.sets(_binary(batch))
            ids = [int(_long(mixed(s).sum(keepdims=True) + np.uint64(len(s)))[0]) for s in sets]
            keys = [[int(_long((s * np.uint64(seed)).min(keepdims=True))[0]) for seed in _SEEDS] if len(s) else [] for s in sets]
            none = [None] * len(sets)
            values = [batch.column("doc_id"), [len(s) for s in sets], ids, keys, none, none]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, kinds)], names=[n for n, _ in kinds])
            for name, s in zip(ids, sets):
                if name not in names:
                    names.add(name)
                    held.append(s)
                    count += len(s)
            if count > COUNTED:
                yield frequent()
                held, count, names = [], 0, set()
        yield frequent()

    return docs.mapInArrow(describe, schema)


@dataclass
class Prefixes:
    """The first shingles of each set, in an order that puts frequent shingles last, and
    others by their hash.

    ``last`` has the first 32 bits of the frequent ones, sorted, and ``met`` their counts: every
    task holds both, so they are kept short. A shingle that begins like a frequent one goes last
    with it, in all sets.

    Two sets that are alike enough share a shingle among the first
    ``n - ceil(p * n) + 1`` of each, where p is ``percent`` / 100, in any one order of
    all shingles; of the smaller set the first ``n - ceil(2p / (1 + p) * n) + 1`` will
    do, which are marked ``short``.
    """

    last: np.ndarray
    met: np.ndarray
    words: int
    percent: int

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Shingles, the ids of their sets, and whether they are short, slice by slice."""
        shingler = Shingler(self.words)
        for batch in slices(batches, "text", SLICE):
            tokens, owners, shorts = [], [], []
            seen: set[int] = set()
            for s in shingler.sets(_binary(batch)):
                if not len(s):
                    continue
                name = int(_long(mixed(s).sum(keepdims=True) + np.uint64(len(s)))[0])
                if name in seen:
                    continue
                seen.add(name)
                size = len(s) + (-self.percent * len(s)) // 100 + 1
                short = len(s) + (-2 * self.percent * len(s)) // (100 + self.percent) + 1
                if len(self.last):
                    begun = (s >> np.uint64(32)).astype(np.uint32)
                    place = np.minimum(np.searchsorted(self.last, begun), len(self.last) - 1)
                    rank = np.where(self.last[place] == begun, self.met[place], 0)
                    s = s[np.argsort(rank, kind="stable")]
                tokens.append(s[:size])
                owners.append(np.full(min(size, len(s)), name, np.int64))
                shorts.append(np.arange(min(size, len(s))) < short)
            yield tuple(np.concatenate([np.zeros(0, k), *x]) for x, k in ((tokens, np.uint64), (owners, np.int64), (shorts, bool)))


def prefix_rows(docs: DataFrame, prefixes: Prefixes) -> DataFrame:
    """``token, set_id, short`` for the shingles of each set's prefix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, owners, shorts in prefixes.of(batches):
            flat = [_long(tokens), owners, shorts]
            for first in range(0, len(tokens), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(f[first : first + 65_536]) for f in flat], names=["token", "set_id", "short"])

    return docs.mapInArrow(rows, "token long, set_id long, short boolean")


def met_again(docs: DataFrame, prefixes: Prefixes, bits: int) -> DataFrame:
    """``head``: the first ``bits`` + 31 bits of each prefix shingle that is met again, at least once short.

    A superset of the shingles that different sets share: copies of a text and shingles
    that agree in their head are in it as well. Shingles travel as four bytes in arrays
    per ``bits`` leading bits, each at most twice from a task's part, so that frequent
    ones stay few.
    """
    low = np.uint64((1 << 32) - 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def part() -> pa.RecordBatch:
            codes = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            codes.sort()
            same = codes | np.uint64(1)
            fresh = np.append(True, same[1:] != same[:-1])[: len(codes)]
            codes = codes[fresh | np.append(fresh[1:], True)[: len(codes)]]
            buckets = (codes >> np.uint64(32)).view(np.int64)
            begins = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])[: len(buckets)])
            offsets = (4 * np.append(begins, len(codes))).astype(np.int32)
            data = (codes & low).astype(np.uint32)
            arrays = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([pa.array(buckets[begins]), arrays], names=["bucket", "codes"])

        for tokens, _, shorts in prefixes.of(batches):
            held.append((tokens >> np.uint64(33 - bits) << np.uint64(1)) | shorts.astype(np.uint64))
            count += len(tokens)
            if count > DEALT:
                yield part()
                count = 0
        yield part()

    def again(table: pa.Table) -> pa.Table:
        codes = np.sort(np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("codes").to_pylist()]))
        edges = np.flatnonzero(np.concatenate([[True], codes[1:] >> 1 != codes[:-1] >> 1, [True]]))
        ends = edges[1:] - 1
        found = codes[ends[(np.diff(edges) > 1) & (codes[ends] & 1 == 1)]] >> 1
        return pa.table({"head": found.astype(np.int64) + (table.column("bucket")[0].as_py() << 31)})

    rows = docs.select("text").mapInArrow(packed, "bucket long, codes binary")
    return rows.groupBy("bucket").applyInArrow(again, "head long")


def set_tokens(docs: DataFrame, words: int, name: str) -> DataFrame:
    """``set_id, n`` of every document, and its shingles: as ``tokens`` whole, as ``prints`` 16 bits of each.

    What two sets share in prints, and what one set shares with a union of prints,
    bounds what they share in shingles from above.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, "text", SLICE):
            sets = shingler.sets(_binary(batch))
            names = [int(_long(mixed(s).sum(keepdims=True) + np.uint64(len(s)))[0]) for s in sets]
            if name == "tokens":
                lists = pa.array([_long(s) for s in sets], pa.list_(pa.int64()))
            else:
                lists = pa.array([np.unique((s & np.uint64(0xFFFF)).astype(np.uint16)).view(np.int16) for s in sets], pa.list_(pa.int16()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), sizes, lists], names=["set_id", "n", name])

    kind = "array<long>" if name == "tokens" else "array<short>"
    return docs.select("text").mapInArrow(tokens, f"set_id long, n long, {name} {kind}")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids, which are sent to all tasks if they are few."""
    wanted = small_if_counted(ids.select(F.col("doc_id").alias("_wanted")).distinct(), BROADCAST_IDS)
    return docs.join(wanted, F.col("doc_id") == F.col("_wanted"), "left_semi")


def _reached(sets: list[np.ndarray], percent: int) -> list[int]:
    """The first of a bounded number of sets that links reach from each, by all their overlaps."""
    sizes = np.array([len(s) for s in sets])
    tokens, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    column = np.cumsum(count > 1) - 1
    met = count[place] > 1
    owner, column = owner[met], column[place[met]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int((count > 1).sum()), 4096):
        inside = (column >= first) & (column < first + 4096)
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[inside], column[inside] - first] = 1
        both += held @ held.T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        reached = np.where(linked, label[None, :], len(sets)).min(axis=1)
        reached = reached[reached]
        if (reached == label).all():
            return label.tolist()
        label = reached


def family_links(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Checked links ``a, b`` between sets that agree in a least hash: a spanning part of them.

    A key that many sets share is dealt at random into buckets of about FAMILY_SETS;
    the other key deals the same sets differently and so joins the buckets.
    """
    keyed = sets.select("doc_id", "set_id", F.posexplode("keys").alias("which", "key"))
    shared = keyed.groupBy("which", "key").count().where("count > 1")
    dealt = keyed.join(shared, ["which", "key"]).withColumn(
        "part", F.pmod(F.xxhash64("set_id", "which"), F.ceil(F.col("count") / FAMILY_SETS))
    )
    dealt = settle(dealt.select("doc_id", "set_id", F.xxhash64("which", "key", "part").alias("family")), "families")
    buckets = max(1, dealt.count() // FAMILY_SETS + 1)
    texts = only(docs, dealt)
    rows = dealt.join(texts, "doc_id").withColumn("bucket", F.pmod(F.xxhash64("family"), F.lit(buckets)))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("set_id", "ascending")])
        shingler = Shingler(words)
        families = table.column("family").to_numpy()
        names = table.column("set_id").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], families[1:] != families[:-1], [True]]))
        out = []
        for a, b in zip(edges, edges[1:]):
            if b - a < 2:
                continue
            sets = shingler.sets(table.column("text").slice(a, b - a).cast(pa.binary()).to_pylist())
            for i, j in zip(range(b - a), _reached(sets, percent)):
                if i != j:
                    out.append((names[a + j], names[a + i]))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.select("bucket", "family", "set_id", "text").groupBy("bucket").applyInArrow(link, "a long, b long")


@dataclass
class Joined:
    """``members``: doc_id, n_shingles, set_id of every document. ``classes``: set_id, class_id, the
    smallest set id that links reach, for sets that have links. ``links``: set_id, family, a set and
    a family of others that holds a set like it."""

    members: DataFrame
    classes: DataFrame
    links: DataFrame


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> Joined:
    """Find what sets of shingles are alike: 100 * intersection >= percent * union, none lost.

    1. Documents with equal sets are one set. 2. Families: sets that agree in a least
    hash are checked against each other until they hang together. 3. Prefix shingles
    that two sets share name candidate sets; families are cut into groups of bounded
    size, and (token, group) rows meet (token, query) rows of other families. 4. A
    group's union, of 16-bit prints, bounds the overlap with each of its members, so a query opens only
    groups whose union holds enough of it, and is then compared with their members.

    Needs at least ``percent`` 1. Null texts and texts without words are empty sets
    and link with nothing; rows without an id as well. Repeated rows are equal sets;
    an empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = settle(describe_sets(rows, words), "sets")
    members = described.where("token IS NULL").select("doc_id", "n", "set_id", "keys")
    sets = settle(
        members.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys")
        ),
        "distinct-sets",
    )
    counts = described.where("token IS NOT NULL").groupBy("token").agg(F.sum("met").alias("met"))
    frequent = counts.orderBy(F.desc("met"), "token").limit(LAST_TOKENS).toArrow()
    # The most frequent of those that begin alike comes first and counts.
    last, first = np.unique((frequent.column("token").to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.uint32), return_index=True)
    met = frequent.column("met").to_numpy()[first]
    met = met.astype(np.min_scalar_type(met.max())) if len(met) else met

    families = components(family_links(rows, sets, words, percent)).select(
        F.col("node").alias("set_id"), F.col("component").alias("family")
    )
    grouped = sets.join(families, "set_id", "left").select(
        "doc_id", "set_id", "n", F.coalesce("family", "set_id").alias("family")
    )
    sizes = grouped.groupBy("family").agg(F.count(F.lit(1)).alias("_sets"))
    grouped = settle(
        grouped.join(sizes, "family").withColumn(
            "part", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("_sets") / GROUP_SETS))
        ).drop("_sets"),
        "groups",
    )

    texts = rows.where("doc_id IS NOT NULL")
    prefixes = Prefixes(last, met, words, percent)
    bits = max(HEAD_BITS, int(sets.agg(F.sum("n")).first()[0] or 0).bit_length() - 24)
    heads = settle(met_again(texts, prefixes, bits), "heads")
    hits = prefix_rows(texts, prefixes).join(
        small_if_counted(heads, BROADCAST_IDS), F.shiftrightunsigned("token", 33 - bits) == F.col("head"), "left_semi"
    )
    hits = settle(hits.distinct(), "hits")
    # Written first, so that the join below has a shuffle of its own and can split hot tokens.
    shared = (
        hits.groupBy("token")
        .agg(F.min("set_id").alias("a"), F.max("set_id").alias("b"), F.max("short").alias("short"))
        .where("a <> b AND short")
    )
    shared = settle(shared.select("token"), "tokens-of-sets")
    hits = settle(hits.join(shared, "token", "left_semi"), "shared-tokens")
    named = hits.join(grouped.select("set_id", "n", "family", "part"), "set_id")
    matrix = named.groupBy("token", "family", "part").agg(
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.min(F.when(F.col("short"), F.col("n"))).alias("least_short"),
        F.max(F.when(F.col("short"), F.col("n"))).alias("most_short"),
    )
    matrix = settle(matrix, "token-groups")
    between = matrix.groupBy("token").agg(F.min("family").alias("a"), F.max("family").alias("b")).where("a <> b")
    between = settle(between.select("token"), "tokens-of-families")
    queries = named.join(between, "token", "left_semi").select("token", "set_id", "n", "short", F.col("family").alias("_family"))
    # The smaller of two sets has the token in its short prefix.
    smaller_there = f"least_short <= n AND 100 * most_short >= {percent} * n"
    smaller_here = f"short AND most >= n AND 100 * n >= {percent} * least"
    pairs = settle(
        queries.join(matrix.join(between, "token", "left_semi"), "token")
        .where(f"family < _family AND ({smaller_there} OR {smaller_here})")
        .groupBy("set_id", "n", "family", "part")
        .agg(F.min("least").alias("least")),
        "query-groups",
    )

    opened = pairs.select("family", "part").distinct()
    inside = grouped.join(opened, ["family", "part"], "left_semi")
    asked = grouped.join(pairs.select("set_id").distinct(), "set_id", "left_semi")
    prints = set_tokens(only(rows, inside.select("doc_id").union(asked.select("doc_id"))), words, "prints")
    prints = settle(prints.dropDuplicates(["set_id"]), "set-prints")
    held = inside.select("set_id", "family", "part").join(prints, "set_id")
    unions = held.groupBy("family", "part").agg(F.array_distinct(F.flatten(F.collect_list("prints"))).alias("union"))
    # Shingles that agree in their print count once in the intersection, so they are added again.
    bound = F.size(F.array_intersect("prints", "union")) + F.col("n") - F.size("prints")
    enough = f"100 * bound >= {percent} * n AND (100 + {percent}) * bound >= {percent} * (n + least)"
    kept = settle(
        pairs.join(prints.select("set_id", "prints"), "set_id")
        .join(unions, ["family", "part"])
        .select("set_id", "family", "part", bound.alias("bound"), "n", "least")
        .where(enough)
        .select("set_id", "family", "part"),
        "opened-groups",
    )
    open_sets = inside.join(kept.select("family", "part").distinct(), ["family", "part"], "left_semi")
    named_sets = kept.select("set_id").union(open_sets.select("set_id")).distinct()
    texts = only(rows, sets.join(named_sets, "set_id", "left_semi"))
    tokens = settle(set_tokens(texts, words, "tokens").dropDuplicates(["set_id"]), "set-tokens")
    # A family hangs together, so one member that is alike links the query to all of it.
    members_of = (
        open_sets.select("set_id", "family", "part")
        .join(tokens, "set_id")
        .groupBy("family", "part")
        .agg(F.collect_list(F.struct("n", "tokens")).alias("members"))
    )
    asking = kept.join(tokens, "set_id").select("set_id", "family", "part", "n", F.col("tokens").alias("asked"))

    def alike(member: Column) -> Column:
        both = F.size(F.array_intersect("asked", member["tokens"]))
        return (100 + percent) * both >= percent * (F.col("n") + member["n"])

    links = asking.join(members_of, ["family", "part"]).where(F.exists("members", alike)).select("set_id", "family")
    links = settle(links.distinct(), "links-between")
    joined = links.join(grouped.select("set_id", F.col("family").alias("a")), "set_id").select("a", F.col("family").alias("b"))
    classes = components(joined)
    whole = families.join(classes.select(F.col("node").alias("family"), "component"), "family", "left").select(
        "set_id", F.coalesce("component", "family").alias("class_id")
    )
    alone = classes.join(families, F.col("node") == F.col("set_id"), "left_anti").select(
        F.col("node").alias("set_id"), F.col("component").alias("class_id")
    )
    return Joined(members.select("doc_id", F.col("n").alias("n_shingles"), "set_id"), whole.union(alone), links)


def document_components(joined: Joined) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id that links or equal sets reach."""
    classed = joined.members.join(joined.classes, "set_id", "left").withColumn(
        "class_id", F.coalesce("class_id", "set_id")
    )
    linked = classed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = linked.groupBy("class_id").agg(F.min("doc_id").alias("component_id"))
    alone = classed.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)")
    return linked.join(least, "class_id").select("doc_id", "n_shingles", "component_id").union(
        alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of what links and equal sets reach.

    Rows without words or without an id stay; rows that repeat both id and text stay once.
    Rows that share an id but not their set are decided each by its own set.
    """
    joined = jaccard_join(docs, words, percent)
    classed = joined.members.where("doc_id IS NOT NULL").join(joined.classes, "set_id", "left")
    classed = settle(classed.select("doc_id", "n_shingles", "set_id", F.coalesce("class_id", "set_id").alias("class_id")), "classed")
    least = classed.where("n_shingles > 0").groupBy("class_id").agg(F.min("doc_id").alias("least"))
    judged = classed.join(least, "class_id", "left").select(
        "doc_id", "set_id", ((F.col("n_shingles") > 0) & (F.col("least") < F.col("doc_id"))).alias("late")
    )
    dropped = judged.groupBy("doc_id").agg(F.max("late").alias("some"), F.min("late").alias("whole")).where("some")
    dropped = settle(dropped.select("doc_id", "whole"), "dropped")
    gone = small_if_counted(dropped.select(F.col("doc_id").alias("_gone")), BROADCAST_IDS)
    kept = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    mixed_ids = dropped.where("NOT whole").select(F.col("doc_id").alias("_mixed"))
    if not mixed_ids.isEmpty():
        mixed = docs.join(mixed_ids, F.col("doc_id") == F.col("_mixed"), "left_semi")
        mixed = settle(mixed.withColumn("_row", F.monotonically_increasing_id()), "mixed-ids")
        described = describe_sets(mixed.select(F.col("_row").alias("doc_id"), "text"), words).where("token IS NULL")
        late = judged.where("late").select(F.col("doc_id").alias("_id"), F.col("set_id").alias("_set")).distinct()
        sets = described.select(F.col("doc_id").alias("_row"), F.col("set_id").alias("_own"))
        stay = mixed.join(sets, "_row").join(late, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_set")), "left_anti")
        kept = kept.unionByName(stay.select(*docs.columns))
    again = settle(
        kept.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "again"
    )
    rows = again.count()
    if not rows:
        return kept
    again = small(again, rows, BROADCAST_IDS)
    same = F.col("doc_id") == F.col("_again")
    return kept.join(again, same, "left_anti").unionByName(
        kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    )
