"""Exact Jaccard join of word-shingle sets by adaptive multi-match prefixes, as components of linked documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWEST, dropped, lower_ascii, mix64, ordered_key, partitions, segment_hashes, session_setup, stored, text_buffer, word_bounds

#: Bytes of text for each slot in which shingles are counted to order them by rarity, and the least and most bits of a slot.
SLOT_BYTES, SLOT_BITS, CHUNK = 2048, (14, 22), 4096
#: Most shared prefix tokens that may be asked for, and list entries that cost as much as fetching one token of a set.
MOST_MATCHES, ENTRIES_A_TOKEN = 64, 16
#: Classes in a token's list up to which the list is cheap: it gives few pairs, whatever the corpus.
CHEAP_LIST = 8
#: Sizes of sets are told apart by steps of 1 / SIZE_STEPS of their logarithm, so that lists meet by size.
SIZE_STEPS = 16
#: Keys of needed documents up to which they are sent to every executor; more are joined by a shuffle.
MOST_SENT = 2_000_000
_M = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (lower-cased A-Z), and where each row's begin; a row of fewer words has its whole sequence as one."""
    data = lower_ascii(data)
    starts, ends, row = word_bounds(data, offsets)
    rows = len(offsets) - 1
    w = segment_hashes(data, starts, ends)
    words = np.bincount(row, minlength=rows)
    first = np.append(0, np.cumsum(words))
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    begin = np.append(0, np.cumsum(count))
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    out = np.zeros(len(at), np.uint64)
    length = np.minimum(np.repeat(words, count), k)
    padded = np.append(w, np.zeros(k, np.uint64))
    for i in range(k):
        out += np.where(i < length, padded[at + i] * _M[i], np.uint64(0))
    return mix64(out + length.astype(np.uint64)), begin


def slot_bits(docs: DataFrame, text: str) -> int:
    """The bits of a slot's number: the slots grow with the bytes of the texts, to a table of 4 MB."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(max(int(size // SLOT_BYTES).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])


def slot_counts(docs: DataFrame, k: int, text: str) -> np.ndarray:
    """How many shingles of the corpus fall into each slot. What a task has counted travels as a row for each CHUNK slots."""
    slots = 1 << slot_bits(docs, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(slots, np.uint32), [], 0
        for batch in batches:
            held.append((shingle_hashes(*text_buffer(batch.column(0)), k)[0] & np.uint64(slots - 1)).astype(np.int32))
            size += len(held[-1])
            if size > slots:
                total += np.bincount(np.concatenate(held), minlength=slots).astype(np.uint32)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=slots).astype(np.uint32)
        parts = total.reshape(-1, CHUNK)
        some = np.flatnonzero(parts.any(1))
        planes = [parts[i].view(np.uint8).reshape(-1, 4).T.tobytes() for i in some]  # high bytes are mostly 0, which packs well
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(planes, pa.binary())], names=["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = -1, np.zeros(CHUNK, np.int64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "n"])
        for batch in batches:
            for i, planes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != now:
                    if now >= 0:
                        yield row()
                    now, total = i, np.zeros(CHUNK, np.int64)
                total += np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]
        if now >= 0:
            yield row()

    counted = docs.select(text).mapInArrow(count, "chunk int, n binary").repartition(partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk")
    out = np.zeros((slots // CHUNK, CHUNK), np.int64)
    for r in counted.mapInArrow(add, "chunk int, n binary").toLocalIterator():
        out[r.chunk] = np.frombuffer(r.n, np.int64)
    return out.reshape(-1)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Each slot's class: 0 where its count is no more than chance spreads, else the bits of what lies above the mean."""
    mean = float(counts.mean())
    above = np.maximum(counts - mean - 4 * np.sqrt(mean) - 4, 0)
    return np.minimum(np.where(above > 0, np.ceil(np.log2(above + mean**0.5 + 2)), 0), 40).astype(np.uint8)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int, classes: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's distinct shingles as tokens in the one order of all: rare classes first, then by hash."""
    h, begin = shingle_hashes(data, offsets, k)
    token = (classes[(h & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (h >> np.uint64(7))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        yield np.unique(token[a:b])


def _identity(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set."""
    m = mix64(tokens)
    a, b = int(m.sum(dtype=np.uint64)), int(mix64(m ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return a - (1 << 63), b - (1 << 63)


def _components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in the edges (a, b): comp is the least node reachable.

    Every round takes each node's least label among its neighbours and then the label of that label, so paths
    shrink by more than half; each round's labels are written to the shared folder.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        step = stored(step, "labels")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        step2 = stored(step.join(jump, "comp", "left").select("node", "old", F.least(F.col("comp"), F.col("far")).alias("comp")), "labels")
        changed = step2.where(F.col("comp") != F.col("old")).limit(1).count()
        labels = step2.select("node", "comp")
        if not changed:
            return labels


def _need(percent: int, n: str = "n"):
    """The least that a set shares with a similar one."""
    return F.ceil(F.col(n) * percent / 100).cast("int")


def _enough(percent: int, x: str, y: str, most):
    """Whether two classes that share most tokens or fewer can be similar."""
    return (100 + percent) * most >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _needed_sets(rows: DataFrame, ids: DataFrame, k: int, classes: np.ndarray) -> DataFrame:
    """(id, tokens) of the classes in ids (id, key, k1, k2), made anew from their documents' texts and from no others."""
    keys = ids.select("key").distinct()
    few = keys.count() <= MOST_SENT
    wanted = rows.join(F.broadcast(keys) if few else keys, "key", "left_semi")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, tokens in zip(batch.column(0).to_pylist(), _sets(*text_buffer(batch.column(1)), k, classes), strict=True):
                if len(tokens):
                    out.append((x, *_identity(tokens), tokens.tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.binary()], strict=True)], names=["key", "k1", "k2", "tokens"])

    got = wanted.mapInArrow(made, "key long, k1 long, k2 long, tokens binary")
    once = got.groupBy("key", "k1", "k2").agg(F.first("tokens").alias("tokens"))  # repeated rows make a set again
    return stored(once.join(ids.select("key", "k1", "k2", "id"), ["key", "k1", "k2"]).select("id", "tokens"), "needed")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar; each a's set travels to its b."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    return stored(two.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")


def _marks(mixed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What the classes know of others by their base prefixes, whole and by entry.

    mixed: the entries of all lists over several components (t, size, id, pos, n, last, rest, comp).
    left: the most that a class can share from an entry on, if its prefix ends first; after: if not.
    """
    prefixes = mixed.groupBy("id").agg(*(F.first(c).alias(c) for c in ("comp", "n", "last", "rest")), F.array_sort(F.collect_list(F.struct("pos", "t", "size"))).alias("at"))
    prefixes = stored(prefixes, "prefixes")
    marks = prefixes.select("id", "comp", "n", "last", "rest", F.size("at").alias("known"), F.posexplode("at").alias("i", "x"))
    marks = marks.select("x.t", "x.size", "id", "comp", "n", "last", "rest", (F.col("rest") + F.col("known") - F.col("i")).alias("left"), (F.col("n") - F.col("x.pos")).alias("after"))
    return prefixes, stored(marks, "marks")


def _ends_first():
    return (F.col("e.last") < F.col("f.last")) | ((F.col("e.last") == F.col("f.last")) & (F.col("e.id") < F.col("f.id")))


def _by_size(entries: DataFrame, percent: int, left: str) -> tuple[DataFrame, DataFrame]:
    """Entries (t, id, comp, n, ...) of lists over several components as two sides of a join on t and step.

    The first side has the entries outside their list's largest component, once for each step of the sizes that a
    similar set can have, if `left` is the most the two can share; the second has all entries by their own size's step.
    """
    counts = entries.groupBy("t", "comp").agg(F.count("*").alias("c"))
    largest = counts.groupBy("t").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("t", "main")
    entries = stored(entries.join(largest, "t"), "entries")
    step = lambda n: F.floor(F.log(n.cast("double")) * SIZE_STEPS).cast("int")
    low, high = _need(percent).cast("long"), F.least(F.floor(F.col("n") * 100 / percent), F.floor(F.col(left) * (100 + percent) / percent) - F.col("n")).cast("long")
    one = entries.where((F.col("comp") != F.col("main")) & (high >= low)).withColumn("step", F.explode(F.sequence(step(low), step(high))))
    return one.alias("e"), entries.withColumn("step", step(F.col("n"))).alias("f")


def _meet():
    return (F.col("e.t") == F.col("f.t")) & (F.col("e.step") == F.col("f.step")) & (F.col("e.comp") != F.col("f.comp"))


def _cheap_pairs(prefixes: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a cheap list and share enough of their base prefixes.

    The first token that two similar classes share lies in the base prefixes of both; there the pair is made, from the
    one whose prefix ends first, if what follows and then what the prefixes share is enough.
    """
    e, f = (marks.where(F.col("size") <= CHEAP_LIST).alias(x) for x in "ef")
    met = e.join(f, (F.col("e.t") == F.col("f.t")) & _ends_first() & (F.col("e.comp") != F.col("f.comp")) & _enough(percent, "e", "f", F.least("e.left", "e.after", "f.after")))
    met = stored(met.select(F.col("e.id").alias("a"), F.col("f.id").alias("b")).distinct(), "met")
    shared = prefixes.select("id", "n", "rest", F.transform("at", lambda x: x["t"]).alias("prefix"))
    e, f = shared.alias("e"), shared.alias("f")
    pairs = met.join(e, F.col("a") == F.col("e.id")).join(f, F.col("b") == F.col("f.id"))
    pairs = stored(pairs.where(_enough(percent, "e", "f", F.size(F.array_intersect("e.prefix", "f.prefix")) + F.col("e.rest"))).select("a", "b"), "pairs")
    dropped(met)
    return pairs


def choose_prefix(sizes: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(m, length) of the prefix that is estimated to cost least for a set of n tokens.

    sizes: how many sets have each of its tokens, ascending. A prefix of n - ceil(t n) + m tokens shares at least m with
    that of any similar set. Its lists hold sum(sizes - 1) entries to read; at most that sum / m others can share m of
    them, and each of these has its set fetched. The m of the least sum of both is taken.
    """
    need = -(-percent * n // 100)
    base = n - need + 1
    most = min(MOST_MATCHES, need)
    entries = np.cumsum(sizes - 1)[base - 1 : base - 1 + most].astype(np.float64)
    m = np.arange(1, most + 1)
    best = int((entries * (1 + n / ENTRIES_A_TOKEN / m)).argmin()) + 1
    return best, base + best - 1


def _costly_pairs(marks: DataFrame, classed: DataFrame, rows: DataFrame, k: int, classes: np.ndarray, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components among the classes that have costly lists, and these classes' sets.

    The classes are ordered anew by how many of them have each token, counted exactly over their whole sets: what a
    class has alone comes first and meets nobody. Each class's prefix gets the length and the number m of shared tokens
    of the least estimated cost. In a list the classes outside its largest component are held against the others whose
    size and place still allow similarity; then the prefixes must share the m of the one that ends first.
    """
    e, f = _by_size(marks.where(F.col("size") > CHEAP_LIST), percent, "after")
    can = _meet() & _enough(percent, "e", "f", F.least("e.after", "f.after", F.when(_ends_first(), F.col("e.left")).otherwise(F.col("f.left"))))
    ids = stored(e.join(f, can, "left_semi").select("id", "comp").unionByName(f.join(e, can, "left_semi").select("id", "comp")).distinct(), "costly")
    sets = _needed_sets(rows, classed.join(ids, "id", "left_semi"), k, classes)

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in got])), pa.array(np.concatenate(got))], names=["id", "t"])

    each = sets.mapInArrow(tokens_of, "id long, t long")
    sizes = stored(each.groupBy("t").agg(F.count("*").cast("int").alias("size")).where("size > 1"), "sizes")
    known = each.join(sizes, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("size", "t"))).alias("at"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], batch.column(3)
            ends = (at.offsets.to_numpy() - at.offsets[0].as_py()).tolist()
            size, token = (at.flatten().field(i).to_numpy() for i in (0, 1))
            for x, comp, n, i, j in zip(*(c.to_pylist() for c in batch.columns[:3]), ends, ends[1:], strict=False):
                alone = n - (j - i)
                if alone > n - -(-percent * n // 100):
                    continue  # its base prefix has nothing that others have
                m, length = choose_prefix(np.append(np.ones(alone, np.int64), size[i:j]), n, percent)
                prefix = token[i : i + length - alone]
                out.append((x, comp, n, alone, m, length, size[i + length - alone - 1], prefix[-1], prefix))
            cols = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "comp", "n", "alone", "m", "length", "last_size", "last", "prefix"])

    plan = known.join(ids, "id").join(classed.select("id", "n"), "id").select("id", "comp", "n", "at")
    plan = stored(plan.mapInArrow(choose, "id long, comp long, n long, alone int, m int, length int, last_size int, last long, prefix array<long>"), "plan")
    dropped(sizes)
    entry = plan.select("id", "comp", "n", "alone", F.posexplode("prefix").alias("i", "t")).withColumn("pos", F.col("alone") + F.col("i"))
    entry = entry.where(F.col("pos") <= F.col("n") - _need(percent)).select("t", "id", "comp", "n", "pos")
    e, f = _by_size(entry.withColumn("left", F.col("n") - F.col("pos")), percent, "left")
    once = (F.col("f.comp") == F.col("f.main")) | (F.col("e.id") < F.col("f.id"))
    met = e.join(f, _meet() & once & _enough(percent, "e", "f", F.least("e.left", "f.left")))
    met = stored(met.select(F.least("e.id", "f.id").alias("a"), F.greatest("e.id", "f.id").alias("b")).distinct(), "met")
    e, f = plan.alias("e"), plan.alias("f")
    shared = F.size(F.array_intersect("e.prefix", "f.prefix"))
    first = F.struct("e.last_size", "e.last") <= F.struct("f.last_size", "f.last")
    rest = F.when(first, F.col("e.n") - F.col("e.length")).otherwise(F.col("f.n") - F.col("f.length"))
    pairs = met.join(e, F.col("a") == F.col("e.id")).join(f, F.col("b") == F.col("f.id"))
    pairs = pairs.where((shared >= F.when(first, F.col("e.m")).otherwise(F.col("f.m"))) & _enough(percent, "e", "f", shared + rest)).select("a", "b")
    pairs = stored(pairs, "pairs")
    for spent in (ids, plan, met, e, f):
        dropped(spent)
    return pairs, sets


def linked_components(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Links documents whose sets of k-word shingles have a Jaccard similarity of percent / 100 or more.

    1. Shingles are counted in hashed slots, whose number grows with the texts; rarer ones come first in one order for all.
    2. Documents with equal sets form a class, of which one takes part in the join.
    3. A set of n tokens has a base prefix of n - ceil(t n) + 1 tokens; two similar sets share at least one of these. The
       lists of the base prefixes tell each class's candidates; tokens that only one class has in its prefix go.
    4. In each token's list the class with the fewest lone tokens is held against the others, if that many lists show the
       two together that they are likely similar. Pairs that pass the exact check are linked; lists that then lie in one
       component are done, whatever their length.
    5. Pairs of different components that meet in a cheap list (CHEAP_LIST classes or fewer) are checked.
    6. Classes with costlier lists get longer prefixes in an order counted among them, and must share as many tokens of
       them as their estimated cost says (choose_prefix) before they are checked.
    Pairs inside a component would add no reachable document. Every check is exact, on whole sets.

    Shingles are told by 57 bits of hash, sets by 128. Documents without words (or null text) have empty sets and
    are linked with nothing; repeated rows are copies; an empty table gives no rows.
    Returns key, n_shingles, component_id (the least key reachable by links, itself included).
    """
    spark = docs.sparkSession
    session_setup(spark)
    classes = rarity(slot_counts(docs, k, text))
    rows = docs.select(ordered_key(key).alias("key"), F.col(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, tokens in zip(batch.column(0).to_pylist(), _sets(*text_buffer(batch.column(1)), k, classes), strict=True):
                n = len(tokens)
                if not n:
                    out.append((x, 0, None, None, None))
                    continue
                out.append((x, n, *_identity(tokens), tokens[: n - -(-percent * n // 100) + 1].view(np.int64)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "n", "k1", "k2", "prefix"])

    table = stored(rows.mapInArrow(describe, "key long, n long, k1 long, k2 long, prefix array<long>"), "sets")
    found = table.where("n > 0").withColumn("id", F.monotonically_increasing_id()).groupBy("k1", "k2").agg(F.min(F.struct("key", "id", "n", "prefix")).alias("s"))
    reps = stored(found.select("k1", "k2", "s.*"), "classes")
    named = stored(table.select("key", "n", "k1", "k2"), "named")  # what is told of each row; its prefix has done
    dropped(table)
    classed = stored(reps.select("k1", "k2", "key", "id", "n", F.element_at("prefix", -1).alias("last")), "classed")
    # the base prefixes' lists
    entries = reps.select("id", F.posexplode("prefix").alias("pos", "t"))
    common = stored(entries.groupBy("t").agg(F.count("*").alias("size")).where("size > 1").select("t"), "common")
    lists = stored(entries.join(common.hint("shuffle_hash"), "t"), "lists")
    dropped(reps)
    dropped(common)
    # Of two prefixes one ends first in the order of tokens. What its class shares lies in both prefixes or past its end,
    # so it is at most rest + the prefix tokens that others have too. That tells nothing of the other class.
    reach = classed.join(lists.groupBy("id").agg(F.count("*").alias("shared")), "id").withColumn("rest", (_need(percent) - 1).cast("long"))
    reach = stored(reach.select("id", "n", "last", "rest", (F.col("rest") + F.col("shared")).alias("most")), "reach")
    all_lists, lists = lists, stored(lists.join(reach, "id"), "lists")
    dropped(all_lists)

    # This step only picks likely links, to lessen what the next have to do, so its bound need not hold for each.
    # Each list's hub: the member that can share most of its set, which is the nearest to what the list's members have in common.
    hubs = stored(lists.groupBy("t").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("lone"), F.col("id"), F.col("n"), F.col("rest"))).alias("s")).select("t", "s.*"), "hubs")
    e, h = lists.alias("e"), hubs.alias("h")
    star = e.join(h, (F.col("e.t") == F.col("h.t")) & (F.col("e.id") != F.col("h.id")))
    star = star.groupBy(F.col("e.id").alias("a"), F.col("h.id").alias("b")).agg(F.count("*").alias("c"), *(F.first(x).alias(y) for x, y in (("e.n", "n"), ("h.n", "hn"), ("e.rest", "rest"), ("h.rest", "hrest"))))
    likely = (100 + percent) * (F.col("c") + F.least("rest", "hrest")) >= percent * (F.col("n") + F.col("hn"))
    pairs = stored(star.where(likely).groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b")), "pairs")  # of several hubs, the one met most
    dropped(hubs)

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        return _needed_sets(rows, classed.join(ids, "id", "left_semi"), k, classes)

    sets = sets_of(pairs)
    links = _verified(pairs, sets, percent)
    dropped(sets)
    dropped(pairs)
    comps = links.select(F.col("a").alias("node"), F.col("b").alias("comp")) if links.isEmpty() else _components(links)
    labelled = stored(lists.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "lists")
    dropped(lists)
    several = labelled.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("t", "size")
    mixed = stored(labelled.join(several, "t"), "mixed")  # what is left: lists over several components
    dropped(labelled)
    prefixes, marks = _marks(mixed, percent)
    dropped(mixed)
    pairs = _cheap_pairs(prefixes, marks, percent)
    dropped(prefixes)
    sets = sets_of(pairs)
    more = _verified(pairs, sets, percent)
    dropped(sets)
    dropped(pairs)
    pairs, sets = _costly_pairs(marks, classed, rows, k, classes, percent)
    more = more.unionByName(_verified(pairs, sets, percent))
    for spent in (sets, pairs, marks, reach):
        dropped(spent)
    if not more.isEmpty():
        comps = _components(links.unionByName(more))
    # labels of classes, then of rows
    known = stored(classed.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "known")
    least = stored(known.groupBy("comp").agg(F.min("key").alias("component")), "least")
    label = known.join(least, "comp").select("k1", "k2", "component")
    out = named.join(label, ["k1", "k2"], "left")
    null = lambda c: F.nullif(c, F.lit(LOWEST))
    return out.select(null(F.col("key")).alias(key), F.col("n").alias("n_shingles"), null(F.coalesce("component", "key")).alias("component_id"))
