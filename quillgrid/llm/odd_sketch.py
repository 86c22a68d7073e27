"""Near duplicates by MinHash bands, Odd sketches and a check on full sets.

A document is the set of its 3-word shingles. Equal sets are one class. Each class has
MinHash samples; bands of them put classes into buckets, and the samples folded into a
parity bitmap (the Odd sketch) let the popcount of an XOR tell similar classes from others
before their full sets are compared. A pair of similarity 0.85 meets in a band with 1 - 2.5e-7
and passes the sketch with about 1 - 1e-7; more similar pairs are safer still. A second
bitmap, of all shingles, rules out pairs that differ in too many, and errs never.

A bucket of any size is worked off in rounds. In each, a few hubs are drawn from the
members outside the bucket's largest component and compared with all members. Confirmed
links join components, and the bucket is done once all of its members are in one, or all
outside the largest have been hubs. So each pair of classes that share a bucket but no
component has been compared, while a group of copies costs a few rows for each member.

Nulls and empty texts: such a document has no shingles, is linked with nothing and is its
own component. A null doc_id never is the smallest of a component; one with ids of null
only has a null component, and its documents count as kept. Repeated rows are one class.
"""

import hashlib
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillgrid.llm.components import roots
from quillgrid.llm.tables import forget, stored
from quillgrid.llm.text import LOWER_BYTES, ROWS, per_batch, raw

SHINGLE = 3
SIMILAR, OF = 85, 100            # link: OF * intersection >= SIMILAR * union
BANDS, ROWS, BITS = 26, 5, 256
#: Bits of the parity bitmap of all shingles. The XOR of two has at most as many bits as the sets
#: differ in shingles, so too many bits rule a link out for certain.
ALL_BITS = 512
SAMPLES = BANDS * ROWS
#: Samples in which two sets may differ and still be compared: 6 deviations above what
#: sets of the least similarity have. Each differing sample flips two bits of the XOR.
DIFFER = SAMPLES * (1 - SIMILAR / OF) + 6 * (SAMPLES * (1 - SIMILAR / OF) * SIMILAR / OF) ** 0.5
FLIPPED = round(BITS / 2 * (1 - exp(-4 * DIFFER / BITS))) + 3
HUBS = (1, 16, 512)              # hubs of a bucket in each round, the last for all further ones
SENT = 1 << 21                   # classes or ids sent to all tasks, after being counted; beyond that texts are dealt by id
CACHED = 60_000                  # words whose hashes a worker keeps; time only

_draw = np.random.default_rng(11)
_FACTORS = _draw.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
_BY_ROW = _draw.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BY_SAMPLE = _draw.integers(0, 1 << 63, SAMPLES, np.uint64)
_BY_WORD = _draw.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


_HASHES = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; of all words if they are fewer."""
    if len(_HASHES) > CACHED:
        _HASHES.clear()
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    return np.unique(mixed(sum(h[k:k + n] * _BY_WORD[k] for k in range(size)) + np.uint64(size)))


def samples(them: np.ndarray) -> np.ndarray:
    """MinHash samples of a set."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for at in range(0, len(them), 2048):
        np.minimum(out, (_FACTORS[:, None] * them[None, at:at + 2048]).min(axis=1), out=out)
    return mixed(out)


def bands(minima: np.ndarray) -> np.ndarray:
    return mixed((minima.reshape(BANDS, ROWS) * _BY_ROW).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))


def parity(them: np.ndarray, bits: int) -> np.ndarray:
    """The parity bitmap of hashes, as 64-bit integers."""
    count = np.bincount((them % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def sketches(them: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """The Odd sketch of the samples, then the bitmap of all shingles."""
    return np.concatenate([parity(mixed(minima ^ _BY_SAMPLE), BITS), parity(mixed(them), ALL_BITS)])


def name_of(them: np.ndarray) -> bytes:
    """The class of a set: 128 bits that no other set shares."""
    return hashlib.blake2b(them.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n, cls, keys, sketch`` of each row."""
    def made(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in raw(batch)]
        minima = [samples(s) for s in sets]
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "n": [len(s) for s in sets],
                "cls": [name_of(s) for s in sets], "keys": [bands(m).view(np.int64) for m in minima],
                "sketch": [sketches(t, m) for t, m in zip(sets, minima)]}
    return per_batch(docs.select("doc_id", "text"), made, "doc_id long,n long,cls binary,keys array<long>,sketch array<long>")


WORDS = [f"s{k}" for k in range((BITS + ALL_BITS) // 64)]


def _may_link(h: Column) -> Column:
    """Whether a member (in columns) and a hub (in a struct) of another component may be linked."""
    flipped = lambda names: sum((F.bit_count(F.col(s).bitwiseXOR(h[s])) for s in names[1:]),
                                F.bit_count(F.col(names[0]).bitwiseXOR(h[names[0]])))
    low, high = F.least(h["n"], F.col("n")), F.greatest(h["n"], F.col("n"))
    both = (OF - SIMILAR) * (h["n"] + F.col("n"))
    return ((h["comp"] != F.col("comp")) & (OF * low >= SIMILAR * high) & (flipped(WORDS[:BITS // 64]) <= FLIPPED)
            & ((OF + SIMILAR) * flipped(WORDS[BITS // 64:]) <= both))


def _members(classes: DataFrame) -> DataFrame:
    """``key, cls`` for buckets of at least two classes."""
    spread = classes.select("cls", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    return spread.join(shared, "key")


def _sent(table: DataFrame) -> DataFrame:
    """To be joined with texts: sent to all tasks unless it has too many rows, so that texts stay where they are."""
    return F.broadcast(table) if table.count() <= SENT else table


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cls, them``: the shingles of the wanted classes, from one document each.

    A class comes by the smallest id of its documents. One without any id is looked for among the
    rows without id by itself, so these rows are no key that all of them share.
    """
    row = docs.select(F.col("doc_id").cast("long").alias("wanted_id"), "text")
    by_id = _sent(wanted.filter("wanted_id is not null"))
    texts = row.filter("wanted_id is not null").join(by_id, "wanted_id").select("cls", "text")

    def made(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in raw(batch)]
        right = [k for k, c in enumerate(batch.column("cls").to_pylist()) if name_of(sets[k]) == c]
        return {"cls": batch.column("cls").take(pa.array(right, pa.int64())), "them": [sets[k].view(np.int64) for k in right]}

    def own(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in raw(batch)]
        return {"cls": [name_of(s) for s in sets], "them": [s.view(np.int64) for s in sets]}
    nameless = per_batch(row.filter("wanted_id is null").select("text"), own, "cls binary,them array<long>")
    nameless = nameless.join(wanted.filter("wanted_id is null").select("cls"), "cls", "left_semi")
    return per_batch(texts, made, "cls binary,them array<long>").unionByName(nameless).dropDuplicates(["cls"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets are similar enough; only sets that a pair names are dealt out."""
    named = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
    if named.count() <= SENT:
        sets = sets.join(F.broadcast(named), "cls", "left_semi")
    one = lambda c, them: sets.select(F.col("cls").alias(c), F.col("them").alias(them))
    common = F.size(F.array_intersect("a", "b"))
    return (pairs.join(one("u", "a"), "u").join(one("v", "b"), "v")
            .withColumn("common", common)
            .filter(OF * F.col("common") >= SIMILAR * (F.size("a") + F.size("b") - F.col("common")))
            .select("u", "v"))


def linked(members: DataFrame, sketched: DataFrame, sets: DataFrame) -> DataFrame:
    """``cls, comp`` for the classes of all buckets; each component is named by one of its classes.

    ``sketched`` has ``cls, n, s0, ...``: bitmaps meet members of open buckets only, in the round that compares them.
    """
    labels = stored(members.select("cls", F.col("cls").alias("comp")).distinct(), "labels")
    done = checked = None
    turn = 0
    while True:
        hubs = HUBS[min(turn, len(HUBS) - 1)]
        named = members.join(labels, "cls")
        sizes = named.groupBy("key", "comp").agg(F.count("*").alias("m"))
        open_keys = (sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("m", "comp")).alias("most"))
                     .filter("comps > 1").select("key", "most"))
        at_work = stored(named.join(open_keys, "key"), "members")
        free = at_work.filter("comp <> most")
        if done is not None:
            free = free.join(done, ["key", "cls"], "left_anti")
        lot = F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(hubs)).alias("lot")
        drawn = stored(free.groupBy("key", lot).agg(F.min(F.struct("cls", "comp")).alias("hub")).select("key", "hub.cls", "hub.comp"), "hubs")
        if drawn.isEmpty():
            forget(at_work, drawn, *(df for df in (done, checked) if df is not None))
            return labels
        # at most `hubs` of them for each bucket
        drawn_lists = drawn.join(sketched, "cls").groupBy("key").agg(F.collect_list(F.struct("cls", "comp", "n", *WORDS)).alias("hubs"))
        met = at_work.select("key", "cls", "comp").join(sketched, "cls").join(drawn_lists, "key").select("cls", F.transform(F.filter("hubs", _may_link), lambda h: h["cls"]).alias("hubs"))
        pairs = (met.filter(F.size("hubs") > 0).select("cls", F.explode("hubs").alias("hub"))
                 .select(F.least("cls", "hub").alias("u"), F.greatest("cls", "hub").alias("v")).distinct())
        if checked is not None:
            pairs = pairs.join(checked, ["u", "v"], "left_anti")
        pairs = stored(pairs, "pairs")
        found = stored(confirmed(pairs, sets), "links")
        if not found.isEmpty():
            label = lambda c: labels.select(F.col("cls").alias(c), F.col("comp").alias(f"{c}_comp"))
            joined = roots(found.join(label("u"), "u").join(label("v"), "v")
                           .select(F.col("u_comp").alias("u"), F.col("v_comp").alias("v")))
            before = labels
            labels = stored(labels.join(joined.withColumnRenamed("node", "comp"), "comp", "left")
                            .select("cls", F.coalesce("root", "comp").alias("comp")), "labels")
            forget(before)
        these = stored(drawn.select("key", "cls"), "drawn")
        done = these if done is None else done.unionByName(these)
        checked = pairs if checked is None else checked.unionByName(pairs)
        forget(at_work, drawn, found)
        turn += 1


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row, its class, and the component by the class that names it."""
    rows = stored(signatures(docs), "signatures")
    classes = stored(rows.filter("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.first("sketch").alias("sketch")), "classes")
    members = stored(_members(classes), "buckets")
    bitmap = [F.col("sketch")[k].alias(s) for k, s in enumerate(WORDS)]
    shared = stored(members.select("cls").distinct().join(
        classes.select("cls", "n", F.col("doc_id").alias("wanted_id"), *bitmap), "cls"), "shared")
    sets = stored(_sets(docs, shared.select("cls", "wanted_id")), "sets")
    labels = linked(members, shared.drop("wanted_id"), sets)
    forget(members, sets, shared)
    named = (classes.select("cls", "doc_id").join(labels, "cls", "left")
             .withColumn("comp", F.coalesce("comp", "cls")))
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(smallest, "comp").select("cls", "component_id", "comp")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (rows.select("doc_id", "n", "cls").join(by_class, "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                    F.equal_null("doc_id", component).alias("kept"), "cls", "comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: size of its set, smallest document reachable over links, and whether it stays."""
    return groups(docs).drop("cls", "comp")


def _with_classes(rows: DataFrame) -> DataFrame:
    """``row, cls``: each row, a struct that has the columns of a document, and its class."""
    schema = StructType([rows.schema["row"], StructField("cls", BinaryType())])

    def made(them):
        for batch in them:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name_of(shingles(t)) for t in raw(part)], pa.binary())],
                                                 names=["row", "cls"])
    return rows.select("row", F.col("row.text").alias("text")).mapInArrow(made, schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, as it is, in all columns of ``docs``, whatever their names.

    Where several rows have one doc_id, or have none, they are told apart by their class: one row
    of a single class stays for each group, and one for each doc_id without any words.
    """
    found = stored(groups(docs), "groups")
    stays = found.filter("kept")
    kept = (stays.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("id"), F.min("cls").alias("cls")).select("id", "cls")
            .unionByName(stays.filter("n_shingles = 0").select(F.col("doc_id").alias("id"), "cls").distinct()))
    times = stored(found.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("m"), F.max("kept").alias("any")), "times")
    again = times.filter("any and (m > 1 or id is null)").select("id")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    by_id = F.col("row.doc_id").cast("long") == F.col("id")
    # the ids of which one row stays as it is are most of all, so the others are named
    others = times.filter("id is not null and not (any and m = 1)").select("id")
    out = rows.filter(F.col("row.doc_id").cast("long").isNotNull()).join(_sent(others), by_id, "left_anti")
    if not again.isEmpty():
        # rows without doc_id are not joined by it, as they would all be one key
        several = rows.join(again, by_id, "left_semi").unionByName(rows.filter("row.doc_id is null"))
        one = _with_classes(several).withColumn("of", F.col("row.doc_id").cast("long")).dropDuplicates(["of", "cls"])
        one = one.join(kept.withColumnRenamed("cls", "kept_cls"), F.expr("of <=> id and cls = kept_cls"), "left_semi")
        out = out.unionByName(one.select("row"))
    return out.select("row.*")
