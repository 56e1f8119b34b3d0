"""Exact Jaccard join of shingle sets over a token-group matrix.

Equal sets are one class from the start. Classes that share minima of several hash functions are
partitioned into groups of a bounded number of tokens, so that similar sets mostly lie together. The
matrix holds, for every group, the tokens that the prefixes of its members have: tokens are put in
one order, rare ones first, and two sets that are similar enough share a token of their prefixes. So
a set needs to look only at the groups that the matrix names for its own prefix. There, the group's
token union bounds the overlap with any member, and only a group that qualifies is opened, which
counts the overlap with each member.

Links are searched in three steps, each of which leaves out pairs that are connected already: within
groups, between the least members of what is connected in a group, and between the rest.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.functions.keyed import join_grouped
from marketloom.llm.common import id_and_text, map_texts
from marketloom.llm.simhash_gray import _merge, components
from marketloom.session import durable

# Counters of the sketch by which tokens are ordered: 8 MB on the driver at any size of the input.
SKETCH = 1 << 23
# Bits that tell which documents' sets are made: 8 MB at any size of the input.
MARKS = 1 << 26
# Rows of about 50 bytes that are sent to all tasks; more are shuffled.
SMALL = 1 << 16
# Tokens of a group's members, and queries of a group that one task takes.
GROUP_TOKENS = 1 << 18
QUERIES = 1 << 13
_STRIPE, _BITS = 1 << 14, 1 << 18
_MINIMA = 3
_ODD = 0x9E3779B97F4A7C15
_M1, _M2, _M3 = (np.uint64(x) for x in (_ODD, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SHIFTS = [np.uint64(_ODD * (k + 1) % (1 << 64)) for k in range(_MINIMA)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def token_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit tokens of every text: shingles of its words, A-Z lower-cased.

    With fewer words than a shingle the whole sequence is one token, told apart by its length.
    """
    words = [t.lower().split() for t in texts.cast(pa.binary()).to_pylist()]
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    named = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    code = named[flat.indices.to_numpy()] if len(flat) else named
    rolled = np.zeros(max(len(code) - shingle + 1, 0), np.uint64)
    for t in range(shingle):
        rolled = _mix(rolled * _M1 + code[t : t + len(rolled)])
    sets, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= shingle:
            sets.append(np.unique(rolled[at : at + n - shingle + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for t in range(n):
                whole = _mix(whole * _M1 + code[at + t : at + t + 1])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def _counts(slim: DataFrame, shingle: int) -> np.ndarray:
    """How many sets hold a token of each counter, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int32)
        for batch in batches:
            tokens = np.concatenate(token_sets(batch.column("text"), shingle))
            np.add.at(total, (tokens % np.uint64(SKETCH)).astype(np.int64), 1)
        if total.any():
            stripes = total.reshape(-1, _STRIPE)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(stripes))),
                    pa.array([zlib.compress(s.astype("<i4").tobytes(), 1) for s in stripes], pa.binary()),
                ],
                ["stripe", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, stripe = np.zeros(_STRIPE, np.int64), None
        for batch in batches:
            for stripe, counts in zip(batch.column("stripe").to_pylist(), batch.column("counts").to_pylist()):
                total += np.frombuffer(zlib.decompress(counts), "<i4")
        # Coarse steps of an eighth of a power of two order tokens as well and need one byte.
        steps = np.minimum(np.log2(total + 1) * 8, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([stripe]), pa.array([steps.tobytes()], pa.binary())], ["stripe", "counts"])

    schema = "stripe long, counts binary"
    parts = map_texts(slim, count, schema).groupBy("stripe").applyInArrow(add, schema).collect()
    steps = np.zeros((SKETCH // _STRIPE, _STRIPE), np.uint8)
    for stripe, counts in parts:
        steps[stripe] = np.frombuffer(counts, np.uint8)
    return steps.ravel()


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` of which any similar set has at least one in its own prefix."""
    return n - -(-percent * n // 100) + 1 if n else 0


_LEAST = [f"m{k}" for k in range(_MINIMA)]
_OWN = f"doc_id long, n int, d1 long, d2 long, {', '.join(f'{m} long' for m in _LEAST)}, prefix array<long>"


def _described(slim: DataFrame, steps, shingle: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = steps.value
        for batch in batches:
            sets = token_sets(batch.column("text"), shingle)
            every = np.concatenate(sets)
            sizes = np.array([len(t) for t in sets], np.int64)
            # One key puts tokens in order: the step of their counter, then most of their bits.
            step = rarity[(every % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64)
            key = (step << np.uint64(56)) | (every >> np.uint64(8))
            filled = np.flatnonzero(sizes)
            starts = np.cumsum(sizes) - sizes
            least = np.zeros((_MINIMA, len(sets)), np.int64)
            if len(filled):
                for k, shift in enumerate(_SHIFTS):
                    least[k, filled] = np.minimum.reduceat(_mix(every + shift), starts[filled]).view(np.int64)
            prefixes, d1, d2 = [], [], []
            for tokens, at in zip(sets, starts):
                n, k = len(tokens), prefix_length(len(tokens), percent)
                own = key[at : at + n]
                first = np.argpartition(own, k - 1)[:k] if k < n else np.arange(n)
                prefixes.append(tokens[first[np.argsort(own[first])]].view(np.int64))
                name = xxhash.xxh128_digest(tokens.astype("<u8").tobytes())
                d1.append(int.from_bytes(name[:8], "big", signed=True))
                d2.append(int.from_bytes(name[8:], "big", signed=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes.astype(np.int32)),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    *[pa.array(m) for m in least],
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "d1", "d2", *_LEAST, "prefix"],
            )

    return map_texts(slim, run, _OWN)


def grouped(classes: DataFrame) -> DataFrame:
    """The group ``grp`` of every class (``id, n`` and the minima).

    Classes that share a minimum take the least label among them, once per hash function; what has
    one label then is cut by hash into groups of about ``GROUP_TOKENS`` tokens.
    """
    labelled = classes.select("id", "n", *_LEAST, F.col("id").alias("label"))
    for m in _LEAST:
        least = labelled.groupBy(m).agg(F.min("label").alias("_label"))
        labelled = join_grouped(labelled, least, m, "inner").withColumn("label", F.col("_label")).drop("_label")
    sizes = labelled.groupBy("label").agg(F.ceil(F.sum("n") / GROUP_TOKENS).alias("pieces"))
    cut = join_grouped(labelled, sizes, "label", "inner")
    piece = F.pmod(F.xxhash64("id"), F.col("pieces"))
    return cut.select("id", F.xxhash64("label", piece).alias("grp"))


def _can_be_similar(percent: int, least: str, most: str, room: str):
    """Whether an entry (``n`` tokens, ``room`` of them from this one on) may belong to a pair with
    one of ``least`` to ``most`` tokens and at most that much room.

    The first token that two sets have in common leaves room for their whole overlap in both.
    """
    need = percent * (F.col("n") + F.col(least))
    return (
        (F.col(most) * 100 >= F.col("n") * percent)
        & (F.col(least) * percent <= F.col("n") * 100)
        & (need <= F.col("room") * (100 + percent))
        & (need <= F.col(room) * (100 + percent))
    )


def _entries(own: DataFrame, percent: int) -> DataFrame:
    """``id, n, token, room``: tokens of the prefixes that another class has in a fitting place.

    All entries are dealt by token once; tokens of one class only are left out there. Partners are
    looked for among size classes of a token, which are few, not among its classes.
    """
    ranked = own.select(F.col("d1").alias("id"), F.col("n").cast("long"), F.posexplode("prefix").alias("rank", "token"))
    dealt = ranked.select("token", "id", "n", (F.col("n") - F.col("rank")).alias("room"))
    # A join with the grouped tokens would move the entries a second time, with other columns.
    alike = Window.partitionBy("token")
    several = dealt.withColumn("_a", F.min("id").over(alike)).withColumn("_b", F.max("id").over(alike))
    held = durable(several.where("_a < _b").drop("_a", "_b").distinct())
    near = (
        held.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(1.02)))
        .groupBy("token", "size")
        .agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("_room"),
            F.min("id").alias("_a"), F.max("id").alias("_b"),
        )
    )
    met = held.join(near, "token").where(_can_be_similar(percent, "least", "most", "_room"))
    return met.where("_a <> id or _b <> id").select(*held.columns).distinct()


def _open(asked: DataFrame, sets: DataFrame, percent: int, own: bool = False) -> DataFrame:
    """Links ``a, b`` between queries and members of the groups in ``asked``.

    ``asked``: ``grp, id, member, comp, hub``: a member of the group, or a query to it. With ``own``
    there are members only, which ask one another. Pairs of one component, and pairs of two hubs
    where ``hub`` is set on both, are not counted again. The queries of a group are dealt to several
    tasks, its members to each of them.
    """
    queries = asked.where("not member").groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).alias("shares"))
    shared = join_grouped(asked, queries, "grp", "left").withColumn("shares", F.coalesce("shares", F.lit(1)).cast("int"))
    one = F.array(F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    dealt = shared.withColumn(
        "share", F.explode(F.when(F.col("member"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(one))
    )
    dealt = durable(dealt.drop("shares"))
    if dealt.count() <= SMALL:
        full = sets.join(F.broadcast(dealt), "id")
    else:
        full = join_grouped(dealt, sets, "id", "inner")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, index = None, [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in batch.to_pylist():
                if (row["grp"], row["share"]) != at:
                    if own and members:
                        found += _within(members, percent)
                    at, members, index = (row["grp"], row["share"]), [], None
                entry = (row["id"], np.frombuffer(row["tokens"], "<u8"), row["comp"], row["hub"])
                if row["member"]:
                    members.append(entry)
                    continue
                index = index or Group(members)
                found += [(entry[0], m) for m in index.similar(entry, percent)]
            if found:
                yield _pairs(found)
        if own and members:
            yield _pairs(_within(members, percent))

    # Members come first, so the queries pass by as a stream.
    sorted_ = full.repartition("grp", "share").sortWithinPartitions("grp", "share", F.desc("member"), "id")
    return map_texts(sorted_, search, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _within(members: list, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a group without queries, by the least ids."""
    index = Group(members)
    root = np.arange(len(members))
    order = np.argsort([m[0] for m in members], kind="stable")
    place = {members[i][0]: rank for rank, i in enumerate(order)}
    for i in order:
        near = [place[m] for m in index.similar(members[i], percent)]
        if near:
            root = _merge(root, np.full(len(near), place[members[i][0]]), np.array(near))
    return [(members[order[r]][0], members[order[i]][0]) for i, r in enumerate(root) if r != i]


class Group:
    """Members of a group: ``union`` of their tokens, and for each of those the members with it."""

    def __init__(self, members: list):
        self.ids = np.array([m[0] for m in members], np.int64)
        self.comps = np.array([m[2] for m in members], np.int64)
        self.hubs = np.array([m[3] for m in members], bool)
        self.sizes = np.array([len(m[1]) for m in members], np.int64)
        tokens = np.concatenate([m[1] for m in members])
        owner = np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.union, starts = np.unique(tokens[order], return_index=True)
        self.owner = owner[order]
        self.starts = np.r_[starts, len(tokens)]

    def similar(self, query: tuple, percent: int) -> list[int]:
        """Ids of members that are similar to the query and not known to be connected with it."""
        own, tokens, comp, hub = query
        place = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        place = place[self.union[place] == tokens]
        # The union bounds the overlap with every member: the group stays shut below what is needed.
        if 100 * len(place) < percent * len(tokens):
            return []
        begin, size = self.starts[place], self.starts[place + 1] - self.starts[place]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.ids))
        close = 100 * shared >= percent * (len(tokens) + self.sizes - shared)
        close &= (self.ids != own) & (self.comps != comp)
        if hub:
            close &= ~self.hubs
        return self.ids[close].tolist()


def similar_documents(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Documents link if their sets of shingles have a Jaccard similarity of ``percent`` hundredths or
    more; equal sets do. ``component_id`` is the least id that links reach. A text without words
    links with nothing, a null text counts as empty. A row without an id has its number of shingles,
    links nothing and has no component. Repeated ids and rows stay, each linked by its own text; very
    long texts are taken whole; other columns are left behind; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = id_and_text(docs, id_col, text_col)
    steps = spark.sparkContext.broadcast(_counts(slim, shingle))
    own = durable(_described(slim, steps, shingle, percent))
    filled = own.where("doc_id is not null and n > 0")
    # Equal sets are one class; ``id`` names it, ``doc_id`` is its least.
    classes = durable(
        filled.groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in ("n", *_LEAST)])
        .withColumn("id", F.col("d1"))
    )
    # The matrix: tokens of prefixes and the groups that have them.
    matrix = durable(join_grouped(_entries(filled, percent), grouped(classes), "id", "inner"))
    sets = durable(_sets_of(slim, classes, matrix.select("id").distinct(), shingle))

    inside = matrix.groupBy("grp", "token").agg(F.count("*").alias("k")).where("k > 1").select("grp", "token")
    hash_on = ["grp", "token"]
    stay = join_grouped(matrix, inside, hash_on, "inner").select("grp", "id").distinct()
    alone = stay.select("grp", "id", F.lit(True).alias("member"), F.col("id").alias("comp"), F.lit(False).alias("hub"))
    links = durable(_open(alone, sets, percent, own=True))

    for hubs_only in (True, False):
        comp = components(links)
        marked = matrix.join(comp.select("id", "component"), "id", "left").withColumn(
            "comp", F.coalesce("component", "id")
        ).drop("component")
        if hubs_only:
            first = links.select(F.greatest("a", "b").alias("id")).distinct().withColumn("_tied", F.lit(True))
            hubs = durable(marked.join(first, "id", "left").withColumn("hub", F.col("_tied").isNull()).drop("_tied"))
            hub_ids = hubs.where("hub").select("id").distinct().withColumn("hub", F.lit(True))
            side = hubs.where("hub")
        else:
            side = marked.join(hub_ids, "id", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
        side = durable(side)
        links = durable(links.unionByName(_open(_asked(side, hubs_only, percent), sets, percent)))
    return _answer(own, classes, links)


def _asked(side: DataFrame, hubs_only: bool, percent: int) -> DataFrame:
    """Queries to groups other than their own, and the members that those groups have in common
    with them. Of two groups the one with the lesser number asks."""
    entries = side.groupBy("token", "grp", "comp").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("_room"), F.min("hub").alias("all_hubs")
    )
    entries = entries.withColumnsRenamed({"grp": "other", "comp": "_comp"})
    new = F.lit(True) if hubs_only else ~(F.col("hub") & F.col("all_hubs"))
    met = (
        side.join(entries, "token")
        .where((F.col("other") > F.col("grp")) & (F.col("_comp") != F.col("comp")) & new)
        .where(_can_be_similar(percent, "least", "most", "_room"))
    )
    # Pairs of hubs were compared in the round of the hubs; there, no flag keeps them apart.
    flag = F.lit(False).alias("hub") if hubs_only else F.col("hub")
    queries = met.select(F.col("other").alias("grp"), "id", F.lit(False).alias("member"), "comp", flag).distinct()
    opened = queries.select("grp").distinct()
    members = side.select("grp", "id", F.lit(True).alias("member"), "comp", flag).distinct()
    return durable(queries).unionByName(join_grouped(members, opened, "grp", "left_semi").select("grp", "id", "member", "comp", "hub"))


def _marks(ids: DataFrame) -> np.ndarray:
    """Bits over hashed places, set where one of ``ids`` (a ``doc_id`` each) falls."""

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(_BITS, np.uint8)
        bits[table.column("at").to_numpy() % _BITS] = 1
        packed = zlib.compress(np.packbits(bits).tobytes(), 1)
        return pa.table({"stripe": table.column("stripe")[:1], "bits": pa.array([packed], pa.binary())})

    places = ids.select(_place().alias("at")).distinct().withColumn("stripe", F.floor(F.col("at") / _BITS))
    marks = np.zeros((MARKS // _BITS, _BITS // 8), np.uint8)
    for stripe, bits in places.groupBy("stripe").applyInArrow(fill, "stripe long, bits binary").collect():
        marks[stripe] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return marks.ravel()


def _place():
    return F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))


def _sets_of(slim: DataFrame, classes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``id, tokens`` of the wanted classes, made anew from the text of their first document.

    Bits tell which documents may be wanted, so the others leave before anything is moved, and what
    is moved are the sets, once. A document that only falls on a bit of another is dropped by the
    join, as are other texts under the same id.
    """
    named = durable(classes.join(wanted, "id").select("d1", "d2", "doc_id"))
    marks = slim.sparkSession.sparkContext.broadcast(_marks(named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = marks.value, set()
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))
            if not batch.num_rows:
                continue
            rows = []
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), token_sets(batch.column("text"), shingle)):
                raw = tokens.astype("<u8").tobytes()
                name = xxhash.xxh128_digest(raw)
                # Repeated rows have the same set.
                if (doc_id, name) not in seen:
                    seen.add((doc_id, name))
                    rows.append((name, doc_id, raw))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(n[:8], "big", signed=True) for n, _, _ in rows], pa.int64()),
                    pa.array([int.from_bytes(n[8:], "big", signed=True) for n, _, _ in rows], pa.int64()),
                    pa.array([d for _, d, _ in rows], pa.int64()),
                    pa.array([r for _, _, r in rows], pa.binary()),
                ],
                ["d1", "d2", "doc_id", "tokens"],
            )

    made = map_texts(
        slim.where("doc_id is not null").select("doc_id", "text", _place().alias("at")),
        run,
        "d1 long, d2 long, doc_id long, tokens binary",
    )
    key = ["d1", "d2", "doc_id"]
    # Grouped by the key of the join, so the sets stay where the join has them.
    return made.join(named, key).groupBy(*key).agg(F.any_value("tokens").alias("tokens")).select(F.col("d1").alias("id"), "tokens")


def _answer(own: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links)
    placed = classes.join(comp, "id", "left").select("id", "d1", "d2", "doc_id", F.coalesce("component", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = join_grouped(placed.drop("doc_id"), least, "component", "inner").select("d1", "d2", "component_id")
    found = join_grouped(own.select("doc_id", "n", "d1", "d2"), named, ["d1", "d2"], "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "component_id")).alias("component_id"),
    )
