"""N-gram Jaccard join by token-combination prefixes, as connected components.

1. Equal shingle sets share one entry. Each entry sends the tokens of an extended prefix, in
   hash order and packed, to counting buckets. A link needs that enough of them occur in
   another set, and what fails that is settled.
2. For the rest, tokens are ordered by frequency. If the first token two linked sets share is
   rare, single tokens of the prefix find it. If it is frequent, the prefix is extended by g
   tokens; then g + 1 shared tokens are frequent, two of them fall into one of g hash classes,
   and the combination of these two is indexed. g grows with the set, so that combinations
   grow as the set does.
3. In each bucket of the index, sets are verified against the bucket's first set. Components
   follow. What a bucket still has in two components is verified pair by pair: pairs of small
   buckets as rows, large buckets as families of sets that are cut into blocks, where blocks
   meet in tasks and only links leave them. So no pairs are formed inside what is already one
   component, and no link is lost. A family of m sets that are similar but not linked costs
   up to m * m / 2 comparisons, which is inherent; rows grow as m * m / BLOCK_ROWS.

Null or empty text has no shingles and is linked with nothing: its component is its own id.
Repeated rows and ids are copies of each other. Null ids are skipped when the smallest id is
taken; a component of null ids only has a null id. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalis.llm.components import components
from credalis.llm.filters import filtered, key_filter
from credalis.llm.frames import arrow_of, batch_of, id_type, stored, text_chunks
from credalis.llm.words import MIX, shingles, words_of

SHINGLE_WORDS = 4
PERCENT = 85
BUCKET_BYTES = 24 << 20
"""Bytes of text for each counting bucket."""
RARE = 64
"""Sets that share a token indexed alone, at most."""
LEVEL = np.log(100 / PERCENT)
"""Step of the logarithm of a set's size from one size level to the next."""
BLOCK_ROWS = 256
"""Sets of a block, on average."""
MANY = np.uint32(0xFFFFFFFF)


def least_overlap(n: np.ndarray | int):
    """Tokens of a set of n that a linked set shares, at least."""
    return -(-PERCENT * n // 100)


def _spare(n: np.ndarray) -> np.ndarray:
    """Tokens by which the counted prefix is extended."""
    return n - least_overlap(n) + 1


def token_sets(texts: list[bytes], width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, sorted within each text; where each text's begin, with the end)."""
    words = words_of(texts)
    if not len(words.ids):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    doc, token = shingles(words.hashes()[words.ids], words, width)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    doc, token = doc[new], token[new]
    return token, np.searchsorted(doc, np.arange(len(texts) + 1))


def _entries(texts: list[bytes], width: int) -> tuple[list[np.ndarray], dict[bytes, int], list[int]]:
    """Distinct sets of some texts: tokens, place of each signature, and the place of each text or -1."""
    token, cut = token_sets(texts, width)
    sets: list[np.ndarray] = []
    place: dict[bytes, int] = {}
    of = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if a == b:
            of.append(-1)
            continue
        sig = hashlib.blake2b(token[a:b].tobytes(), digest_size=16).digest()
        if sig not in place:
            place[sig] = len(sets)
            sets.append(token[a:b])
        of.append(place[sig])
    return sets, place, of


def _local(width: int, buckets: int, schema: pa.Schema):
    """Rows of entries (sig not null) and of packed prefix tokens (bucket not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in text_chunks(batches):
            sets, place, of = _entries(texts, width)
            members: list[list] = [[] for _ in sets]
            alone = []
            for i, k in zip(ids.to_pylist(), of, strict=True):
                (members[k] if k >= 0 else alone).append(i)
            n = np.array([len(s) for s in sets], np.int64)
            size = np.minimum(n, n - least_overlap(n) + _spare(n))
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), size)
            token = np.concatenate([s[:k] for s, k in zip(sets, size.tolist(), strict=True)] or [np.zeros(0, np.uint64)])
            kinds, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
            shared = count[inverse] > 1
            marks = np.bincount(owner[shared], minlength=len(sets))
            first = np.full(len(kinds), MANY)
            first[inverse[~shared]] = owner[~shared]
            bucket = ((kinds * MIX) >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(chunk, k, sig, int(n[k]), int(marks[k]), members[k], None, None, None) for sig, k in place.items()]
            if alone:
                rows.append((chunk, -1, None, 0, 0, alone, None, None, None))
            for b in range(buckets):
                own = order[cut[b] : cut[b + 1]]
                if len(own):
                    rows.append((chunk, None, None, None, None, None, b, kinds[own].astype(np.uint32).tobytes(), first[own].tobytes()))
            yield batch_of(schema, *(list(c) for c in zip(*rows, strict=True)))

    return run


def _count_bucket(key: tuple, table: pa.Table) -> pa.Table:
    """For each chunk, packed: entries with tokens of this bucket that other sets have too, and how many."""
    tokens = [np.frombuffer(x, np.uint32) for x in table.column("tokens").to_pylist()]
    owner = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("owners").to_pylist()])
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(t) for t in tokens])
    token = np.concatenate(tokens)
    order = np.argsort(token, kind="stable")
    token, owner, chunk = token[order], owner[order], chunk[order]
    same = token[1:] == token[:-1]
    found = (np.append(same, False) | np.append(False, same)) & (owner != MANY)
    owner, chunk = owner[found], chunk[found]
    rows: list[tuple] = []
    for c in np.unique(chunk):
        entry, marks = np.unique(owner[chunk == c], return_counts=True)
        rows.append((int(c), entry.tobytes(), marks.astype(np.uint32).tobytes()))
    return pa.Table.from_batches([batch_of(MARKS, *(list(x) for x in zip(*rows, strict=True)))]) if rows else MARKS.empty_table()


MARKS = pa.schema([("chunk", pa.int64()), ("entries", pa.binary()), ("marks", pa.binary())])


def _sum_marks(key: tuple, table: pa.Table) -> pa.Table:
    """Marks of each entry of one chunk."""
    entry = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("entries").to_pylist()])
    marks = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("marks").to_pylist()])
    total = np.bincount(entry, marks).astype(np.int64)
    own = np.flatnonzero(total)
    return pa.table({"chunk": np.full(len(own), key[0].as_py()), "entry": pa.array(own, pa.int32()), "more": total[own]})


def _sets(width: int, schema: pa.Schema):
    """Signature and tokens of the distinct sets of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in text_chunks(batches):
            sets, place, _ = _entries(texts, width)
            yield batch_of(schema, list(place), [s.view(np.int64) for s in sets])

    return run


def classes_at(level: int) -> int:
    """g for the sets that meet at a size level: about the tokens that linked sets of this size may differ in."""
    return max(1, round((100 - PERCENT) / 100 * np.exp(level * LEVEL)))


def signatures(n: int, freq: np.ndarray, token: np.ndarray, rare: int = RARE) -> list[np.ndarray]:
    """Index keys of a set of n tokens, given those that other sets share, rarest first.

    Sizes of linked sets are at most one level apart, so a set is indexed at its own level
    and the next; g belongs to the level.
    """
    prefix = n - least_overlap(n) + 1 - (n - len(token))  # tokens that no other set has come first
    token = token.view(np.uint64)
    own = int(np.log(n) / LEVEL)
    out = []
    for level in (own, own + 1):
        g = classes_at(level)
        keys = [token[: max(prefix, 0)][freq[: max(prefix, 0)] <= rare]]
        part = token[: max(prefix + g, 0)][freq[: max(prefix + g, 0)] > rare]
        group = (part * MIX >> np.uint64(20)) % np.uint64(g)
        order = np.argsort(group, kind="stable")
        part, cut = part[order], np.flatnonzero(np.diff(group[order])) + 1
        for t in np.split(part, cut):
            if len(t) > 1:
                t = np.sort(t)
                a, b = np.triu_indices(len(t), 1)
                keys.append(((t[a] * MIX) ^ t[b]) * MIX)
        out.append(np.unique(np.concatenate(keys)) * MIX + np.uint64(level))
    return out


def _index(rare: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, n, shared in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                values = shared.values
                keys = np.concatenate(signatures(n, values.field(0).to_numpy(), values.field(1).to_numpy(), rare)).view(np.int64)
                if len(keys):
                    yield batch_of(schema, keys, np.full(len(keys), rid), np.full(len(keys), n))

    return run


def _linked(overlap: Column, a: Column, b: Column) -> Column:
    return 100 * overlap >= PERCENT * (a + b - overlap)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. ``sets``: rid, n, tokens that other sets share."""
    left = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_linked(F.size(F.array_intersect("ta", "tb")), F.col("na"), F.col("nb"))).select("a", "b")


def _sizes_fit(a: str, b: str) -> Column:
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def links(sets: DataFrame, rare: int = RARE) -> DataFrame:
    """Links (a, b) that join all linked sets into their components. ``sets``: rid, n, tokens."""
    token = sets.select("rid", "n", F.explode("tokens").alias("t"))
    freq = token.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    ordered = token.join(freq, "t").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("shared"))
    least = F.ceil(F.col("n") * PERCENT / 100)
    ordered = stored(ordered.where(F.size("shared") >= least))
    small = ordered.select("rid", "n", F.col("shared.t").alias("tokens"))
    index_ddl = "key long, rid long, n long"
    index = stored(ordered.select("rid", "n", "shared").mapInArrow(_index(rare, arrow_of(index_ddl)), index_ddl))
    hubs = index.groupBy("key").agg(F.min(F.struct("rid", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", F.col("hub.rid").alias("a"), F.col("hub.n").alias("na"))
    first = index.join(hubs, "key").where((F.col("a") < F.col("rid")) & _sizes_fit("na", "n")).select("a", F.col("rid").alias("b")).distinct()
    first = stored(first)
    found = stored(_verified(first, small))
    part = components(found.select("a", "b"))
    # what is still in two components of one bucket: pairs of small buckets, blocks of large ones
    at = index.join(part.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("c", F.coalesce("component", "rid")).drop("component")
    per = at.groupBy("key", "c").agg(F.count("*").alias("m"))
    mixed = per.groupBy("key").agg(F.sum("m").alias("m"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    open_ = stored(at.join(mixed, "key"))
    few = open_.where(F.col("m") <= rare)
    fits = (F.col("x.rid") < F.col("y.rid")) & (F.col("x.c") != F.col("y.c")) & _sizes_fit("x.n", "y.n")
    pairs = few.alias("x").join(few.alias("y"), F.col("x.key") == F.col("y.key")).where(fits)
    pairs = pairs.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    many = open_.where(F.col("m") > rare)
    families = components(many.join(hubs, "key").select("a", F.col("rid").alias("b")))
    crowd = families.select(F.col("node").alias("rid"), F.col("component").alias("family"))
    crowd = crowd.join(many.groupBy("rid").agg(F.first("c").alias("c")), "rid").join(small, "rid")
    return found.unionByName(stored(_verified(pairs, small))).unionByName(stored(_block_links(crowd)))


def _block_links(crowd: DataFrame) -> DataFrame:
    """Links between the sets of a family that are not in one component yet: rid, n, c, tokens, family.

    Families are cut by size and hash into blocks; two blocks meet in one task if their sizes
    are near enough, and only links leave it.
    """
    crowd = stored(crowd.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / float(LEVEL)).cast("int")))
    parts = crowd.groupBy("family", "size").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    own = crowd.join(parts, ["family", "size"]).withColumn("h", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    above = parts.select("family", (F.col("size") - 1).alias("size"), F.col("parts").alias("above"))
    below = parts.select("family", (F.col("size") + 1).alias("size"), F.col("parts").alias("below"))
    own = own.join(above, ["family", "size"], "left").join(below, ["family", "size"], "left")

    def meetings(n: str, make) -> Column:
        return F.transform(F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), make)

    def meeting(size: Column, a: Column, b: Column, up: int, right: Column) -> Column:
        return F.struct(size.alias("low"), F.lit(up).alias("up"), a.alias("p"), b.alias("q"), right.alias("right"))

    h, size = F.col("h"), F.col("size")
    where = F.concat(
        meetings("parts", lambda j: meeting(size, F.least(h, j), F.greatest(h, j), 0, h > j)),
        meetings("above", lambda j: meeting(size, h, j, 1, F.lit(False))),
        meetings("below", lambda j: meeting(size - 1, j, h, 1, F.lit(True))),
    )
    met = own.select("family", "rid", "n", "c", "tokens", F.explode(where).alias("w")).select("family", "w.*", "rid", "n", "c", "tokens")
    return met.groupBy("family", "low", "up", "p", "q").applyInArrow(_verify_block, "a long, b long")


def _verify_block(key: tuple, table: pa.Table) -> pa.Table:
    """Links between the two sides of a meeting (or inside one block), no more than join what is apart."""
    up, p, q = (k.as_py() for k in key[2:])
    rid, n, part, right = (table.column(c).to_numpy() for c in ("rid", "n", "c", "right"))
    lists = table.column("tokens").combine_chunks()
    sizes = np.array([len(x) for x in lists], np.int64)
    place = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1].reshape(-1)
    starts = np.cumsum(sizes) - sizes
    root: dict[int, int] = {int(c): int(c) for c in part}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    alone = up == 0 and p == q
    others = np.arange(len(rid)) if alone else np.flatnonzero(right)
    found = []
    mark = np.zeros(place.max(initial=0) + 1, np.int64)
    sums = np.concatenate([starts, [len(place)]])
    for i in range(len(rid)) if alone else np.flatnonzero(~right):
        own = place[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        total = np.concatenate([[0], np.cumsum(mark[place])])
        mark[own] = 0
        overlap = total[sums[others + 1]] - total[sums[others]]
        for j in others[100 * overlap >= PERCENT * (n[i] + n[others] - overlap)]:
            a, b = find(int(part[i])), find(int(part[j]))
            if a != b:
                root[a] = b
                found.append((int(rid[i]), int(rid[j])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, rare: int = RARE) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links)."""
    kind = id_type(docs, id_col)
    pairs = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    size = pairs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ddl = f"chunk long, entry int, sig binary, n long, marks long, members array<{kind}>, bucket int, tokens binary, owners binary"
    local = stored(pairs.mapInArrow(_local(width, max(1, -(-size // BUCKET_BYTES)), arrow_of(ddl)), ddl))
    entries = local.where("members is not null").select("chunk", "entry", "sig", "n", "marks", "members")
    more = local.where("bucket is not null").select("chunk", "bucket", "tokens", "owners").groupBy("bucket").applyInArrow(_count_bucket, "chunk long, entries binary, marks binary")
    more = more.groupBy("chunk").applyInArrow(_sum_marks, "chunk long, entry int, more long")
    least = F.ceil(F.col("n") * PERCENT / 100)
    need = least - F.ceil(least * PERCENT / 100) + 1  # the extension of the smallest set that may be linked
    marked = entries.where("n > 0").join(more, ["chunk", "entry"], "left").where(F.col("marks") + F.coalesce("more", F.lit(0)) >= need)
    marked = stored(marked.select("sig", "n", F.explode("members").alias("i")).withColumn("h", F.xxhash64("i")))
    held = docs.sparkSession.sparkContext.broadcast(key_filter(marked.select("h")))
    set_ddl = "sig binary, tokens array<long>"
    chosen = filtered(pairs.select("t", F.xxhash64("i").alias("h")), held).select("h", "t").mapInArrow(_sets(width, arrow_of(set_ddl)), set_ddl)
    chosen = chosen.groupBy("sig").agg(F.first("tokens").alias("tokens"))
    keys = marked.groupBy("sig").agg(F.max("n").alias("n"))
    sets = stored(chosen.join(keys, "sig").withColumn("rid", F.monotonically_increasing_id()))
    part = components(links(sets.select("rid", "n", "tokens"), rare))
    reached = sets.select("sig", "rid").join(part.select(F.col("node").alias("rid"), "component"), "rid").select("sig", "component")
    own = entries.where("n > 0").groupBy("sig").agg(F.min(F.array_min("members")).alias("low")).join(reached, "sig", "left")
    low = own.where("component is not null").groupBy("component").agg(F.min("low").alias("lowest"))
    named = own.join(low, "component", "left").select("sig", F.coalesce("lowest", "low").alias("component_id"))
    full = entries.where("n > 0").join(named, "sig").select(F.explode("members").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    empty = entries.where("n = 0").select(F.explode("members").alias(id_col), F.lit(0).cast("long").alias("n_shingles"))
    return full.unionByName(empty.withColumn("component_id", F.col(id_col)))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay when each group of linked documents keeps the one with the smallest id.

    Rows alike in id and text are one document. Only rows of groups are shuffled whole.
    """
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h"))
    member = F.struct(F.col("i").isNull().alias("none"), F.col("i").alias("id"), "h")
    near = stored(near_copies(named.select(member.alias("m"), "t"), "m", "t", width).select("m", F.col("component_id").alias("c")))
    crowd = near.groupBy("c").agg(F.count("*").alias("size")).where("size > 1").select("c")
    grouped = stored(near.join(crowd, "c").select(F.col("m.h").alias("h"), (F.col("m") == F.col("c")).alias("stays")))
    held = docs.sparkSession.sparkContext.broadcast(key_filter(grouped.select("h")))
    rows = named.select("row", "h")
    maybe = filtered(rows, held).join(grouped.groupBy("h").agg(F.max("stays").alias("stays")), "h", "left")
    alone = maybe.where("stays is null").select("row")
    kept = maybe.where("stays").dropDuplicates(["h"]).select("row")
    return filtered(rows, held, False).select("row").unionByName(alone).unionByName(kept).select("row.*")
