"""Links between texts whose sets of word n-grams overlap, as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are sets of equal documents (classes), columns are n-gram hashes. Two sets that reach the similarity share a column
among each one's first few (size - least overlap + 1) under one order, in which n-grams that a sample shows often come last; entries of the
product outside pairs of rows that share such a column aren't asked for. Pairs come from those columns block by block: first each row with the row that most of its
columns name, then a growing share of a column's rows as partners (pivots), until every pair of a column that is not yet connected has been
counted or ruled out by bounds. Rows of a long column meet only where they share a second one.

The overlap of the pairs is summed over blocks of all columns: in each block the rows' entries are intersected and the counts are added up, and
pairs go whose overlap can't reach the bound any more that their sizes set, whatever the rest of their columns holds. Before that, sizes alone
and sketches rule pairs out: each set has the parity of its n-grams in each of SKETCH cells, and two sets differ in as many n-grams at least
as their sketches differ in cells. Copies of one set are one row, so no group of them is expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import bitmap, bits_for, passing
from .components import components
from .keep import with_groups
from .scratch import Scratch, bounded_batches
from .words import SPACED, U, Words, lists, mix, pieces, signed, text_buffer

#: A table of so many buckets of n-grams tells which come late in the order, and one of an eighth as many which come last: 18 MB of bits whatever the
#: input. Buckets are counted by pages.
BUCKET_BITS, PAGE_BITS, COARSE_BITS = 27, 15, 3
BUCKETS, PAGE = 1 << BUCKET_BITS, 1 << PAGE_BITS
#: Parts in which the driver reads the bits.
READ = 8
#: N-grams of so many documents come late in the order, and those of so many last. It changes speed, never results.
OFTEN, COMMON = 2, 16
#: Cells of a sketch.
SKETCH = 1024
#: The share of pivots grows by this factor from round to round; columns with open pairs after LONG pivots are parted by second columns.
WIDEN, LONG = 32, 1024
#: Blocks of columns over which overlaps are summed, by the first bits of the hash.
BLOCK_BITS = 2
BLOCKS = 1 << BLOCK_BITS
#: Stands for a null doc_id where entries are told by it and their set's name.
NO_ID = -(1 << 63)


def _grams(w: Words, n: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, sorted; a text of fewer words is one n-gram."""
    h, out = w.windows(n), []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= n:
            s = np.sort(h[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            short = np.array([b - a], U)
            for i in range(a, b):
                short = mix(short * U(0x9E3779B97F4A7C15) + w.hash[i : i + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, U))
    return out


def _ordered(s: np.ndarray, late: np.ndarray | None) -> np.ndarray:
    """The column numbers of a set, in the order of columns: 62 bits of the hash, late ones after all others."""
    key = s >> U(3)
    if late is not None:
        for bits, size, place in zip(late, (BUCKET_BITS, BUCKET_BITS - COARSE_BITS), (U(61), U(62)), strict=True):
            bucket = s >> U(64 - size)
            key |= ((bits[bucket >> U(3)] >> (bucket & U(7)).astype(np.uint8)) & 1).astype(U) << place
    return np.sort(key)


def _name(s: np.ndarray) -> bytes:
    """16 bytes that tell a set."""
    return np.array([np.add.reduce(mix(s)), np.bitwise_xor.reduce(mix(~s)) + U(len(s))], U).tobytes()


def _sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the set's n-grams in each cell, as SKETCH / 64 numbers."""
    odd = (np.bincount((s & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _texts(batches, each):
    """Runs each(words, slice of ids) over whole texts."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b, x, y in pieces(data, offsets):
            yield each(Words(x, y, SPACED, True), [batch.column(i).slice(a, b - a) for i in (0, 2)])


def _buckets(n: int):
    """text to (page, places in the page, two bytes each) of the buckets of its n-grams, a row for each page and batch."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            found = [np.concatenate(_grams(Words(x, y, SPACED, True), n)) >> U(64 - BUCKET_BITS) for _, _, x, y in pieces(data, offsets)]
            bucket = np.sort(np.concatenate(found)) if found else np.zeros(0, U)
            page = (bucket >> U(PAGE_BITS)).astype(np.int32)
            first = np.flatnonzero(np.concatenate([page[:1] >= 0, page[1:] != page[:-1]]))
            places = (bucket & U(PAGE - 1)).astype(np.uint16)
            bound = np.append(first, len(page)).astype(np.int32) * 2
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bound), pa.py_buffer(places)])
            yield pa.RecordBatch.from_arrays([pa.array(page[first]), blobs], ["page", "places"])

    return run


def _counted(late: int, last: int):
    """Rows sorted by page to the bits of the buckets that so many documents have; a task holds the counts of one page."""

    def bits(page, counts):
        coarse = counts.reshape(-1, 1 << COARSE_BITS).sum(1)
        return page, *(np.packbits(c >= least, bitorder="little").tobytes() for c, least in ((counts, late), (coarse, last)))

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["page", "late", "last"])

    def run(batches):
        at, counts = None, None
        for batch in batches:
            out = []
            for page, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if page != at:
                    if at is not None:
                        out.append(bits(at, counts))
                    at, counts = page, np.zeros(PAGE, np.int64)
                counts += np.bincount(np.frombuffer(places.as_buffer(), np.uint16), minlength=PAGE)
            if out:
                yield rows(out)
        if at is not None:
            yield rows([bits(at, counts)])

    return run


def _often(docs: DataFrame, n: int, scratch: Scratch) -> tuple[list[np.ndarray] | None, bool]:
    """Two bits for each bucket of n-grams: whether OFTEN documents hold one, and whether COMMON do; and whether one document at most holds each
    n-gram whose first bit isn't set. Where chance puts two or more into each bucket (texts of over 1.6 GB) the bits tell the order only, and that isn't so."""
    chance = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6 // BUCKETS  # what chance puts into a bucket, with six bytes a word
    alone = chance < 2
    held = docs.select("text").mapInArrow(_buckets(n), "page int, places binary").repartition("page").sortWithinPartitions("page")
    pages = scratch.table(held.mapInArrow(_counted(OFTEN if alone else OFTEN + chance, COMMON + 2 * (chance + 1 << COARSE_BITS)), "page int, late binary, last binary"))
    sizes = (PAGE // 8, PAGE // 8 >> COARSE_BITS)
    out = [np.zeros((BUCKETS // PAGE) * size, np.uint8) for size in sizes]
    for r in pages.coalesce(READ).toLocalIterator():  # 4096 pages of 4.5 KB at most; each partition is a job of its own
        for bits, mine, size in zip(out, (r.late, r.last), sizes, strict=True):
            bits[r.page * size : (r.page + 1) * size] = np.frombuffer(bytes(mine), np.uint8)
    scratch.drop(pages)
    return out if out[0].any() else None, alone


def _prefixes(n: int, share: int, late):
    """doc_id, text, text_hash to doc_id, text_hash, n, cls (16 bytes that tell the set), the columns that come first in the order and one more, with
    their places in it, and the sketch. Columns that no other row can have are left out; they come before all others."""

    def run(batches):
        late_bits, alone = late.value

        def each(w, ids):
            size, held, places = [], [], []
            sets = _grams(w, n)
            for s in sets:
                m = len(s)
                size.append(m)
                first = _ordered(s, late_bits)[: m - -(-share * m // 100) + 2]
                skip = int(np.searchsorted(first, U(1 << 61))) if alone else 0
                held.append(first[skip:])
                places.append(np.arange(skip, len(first)))
            bound = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            names = pa.array(map(_name, sets), pa.binary())
            cells = lists(np.concatenate([_sketch(s) for s in sets]), np.arange(len(sets) + 1) * (SKETCH // 64), pa.int64())
            first = [lists(signed(np.concatenate(held)), bound, pa.int64()), lists(np.concatenate(places), bound, pa.int64())]
            return pa.RecordBatch.from_arrays([*ids, pa.array(size, pa.int64()), names, *first, cells], ["doc_id", "text_hash", "n", "cls", "first", "places", "sketch"])

        yield from _texts(batches, each)

    return run


def _sets(n: int):
    """doc_id, text to id (doc_id, NO_ID for null), the set's name and its entries in each block of columns; rows that repeat within a task are told once."""
    edges = np.arange(1, BLOCKS, dtype=U) << U(64 - BLOCK_BITS)

    def run(batches):
        seen: set[tuple[int, bytes]] = set()

        def each(w, ids):
            ids = ids[0].fill_null(NO_ID).to_pylist()
            grams = _grams(w, n)
            fresh = {k: s for k, s in zip(zip(ids, map(_name, grams), strict=True), grams, strict=True) if k not in seen}
            seen.update(fresh)
            size = np.array([np.diff(np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])) for s in fresh.values()], np.int64).reshape(-1)
            bound = np.concatenate([[0], np.cumsum(size)])
            each_block = pa.array(np.repeat(np.arange(len(fresh)), BLOCKS))
            told = [pa.array([k[i] for k in fresh], kind).take(each_block) for i, kind in enumerate((pa.int64(), pa.binary()))]
            flat = signed(np.concatenate([np.zeros(0, U), *fresh.values()]))
            return pa.RecordBatch.from_arrays([*told, pa.array(np.tile(np.arange(BLOCKS, dtype=np.int32), len(fresh))), lists(flat, bound, pa.int64())], ["id", "cls", "block", "entries"])

        yield from _texts(batches, each)

    return run


def _alike(a: str, b: str, share: int) -> str:
    """Whether the sketches of rows of n_a and n_b n-grams leave them as a pair."""
    apart = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH // 64))
    return f"{100 + share} * ({apart}) <= {100 - share} * (n_a + n_b)"


def _within(pairs: DataFrame, told: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) of rows that the bounds on sizes and sketches leave."""
    a = told.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = told.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(a, "a").join(b, "b").filter(_near("n_a", "n_b", share))
    return both.filter(_alike("sketch_a", "sketch_b", share)).select("a", "b")


def _distinct_columns(entries: DataFrame, scratch: Scratch, order: str = "col") -> DataFrame:
    """Entries (col, row, place, m) of columns of m rows to those of columns that differ in their rows, with the first row and how many columns are
    the same. Of columns of the same rows the first in the order stays: in every row its place is before those of the others."""
    told = F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y")
    columns = entries.groupBy("col", "m").agg(F.min("row").alias("first"), F.min(order).alias("order"), *told)
    columns = columns.groupBy("m", "first", "x", "y").agg(F.min_by("col", "order").alias("col"), F.count("*").alias("same"))
    return scratch.table(entries.join(columns.select("col", "first", "same"), "col"))


def _near(a: str, b: str, share: int) -> str:
    return f"100 * least({a}, {b}) >= {share} * greatest({a}, {b})"


def _reaches(n: str, place: str, least: str, share: int) -> str:
    """Whether a row of n columns of which place ones have no partner can reach the similarity with one of least columns or more."""
    return f"100 * {n} - {100 + share} * ({place}) >= {share} * {least}"


def _shared(entries: DataFrame, share: int, scratch: Scratch) -> DataFrame:
    """Entries (col, row, place, n) to col, row, place, n, m of the columns of m rows, where two rows may be near by their sizes: columns of two or three
    rows go if no two are, which the sums tell; longer ones stay. Entries go whose place leaves too few for the column's smallest row, also if one that
    is shared lies before."""
    sums = F.count("*").alias("m"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), (F.sum("n") - F.min("n") - F.max("n")).alias("mid_n")
    three = f"{_near('least_n', 'mid_n', share)} OR {_near('mid_n', 'most_n', share)}"
    columns = entries.groupBy("col").agg(*sums).filter(f"m > 3 OR m = 3 AND ({three}) OR m = 2 AND {_near('least_n', 'most_n', share)}")
    held = entries.join(columns.select("col", "m", "least_n"), "col").filter(_reaches("n", "place - 1", "least_n", share))
    return scratch.table(held.select("col", "row", "place", "n", "m"))


def _product(pairs: DataFrame, docs: DataFrame, told: DataFrame, n: int, share: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of rows whose overlap, summed over all blocks of columns, reaches the similarity. Entries are read from the texts again."""
    names = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    inside = scratch.table(told.select("row", "cls", "doc_id", "n").join(names, "row", "left_semi"))
    bits, key = bits_for(inside.count()), ["id", "cls"]
    # Entries go by doc_id and the set's name, so that no join is needed to tell their row; copies that pass by chance are met by no pair.
    again = passing(docs, "doc_id", within=bitmap(inside, "doc_id", bits=bits), bits=bits).mapInArrow(_sets(n), "id long, cls binary, block int, entries array<long>")
    entries = scratch.table(passing(again, *key, within=bitmap(inside.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))), *key, bits=bits), bits=bits))
    size = [inside.select(F.col("row").alias(x), F.coalesce("doc_id", F.lit(NO_ID)).alias(f"id_{x}"), F.col("cls").alias(f"cls_{x}"), F.col("n").alias(f"n_{x}"), F.col("n").alias(f"left_{x}")) for x in "ab"]
    held = pairs.select("a", "b", F.lit(0).cast("long").alias("overlap")).join(size[0], "a").join(size[1], "b")
    pair = ["a", "b", "id_a", "id_b", "cls_a", "cls_b", "n_a", "n_b"]
    by = [*pair, "overlap", "left_a", "left_b"]
    # The first block alone rules most pairs out that the sketches let pass; the others are summed at once, of the sets that are left.
    for blocks in ([0], [*range(1, BLOCKS)]):
        some = entries.filter(F.col("block").isin(blocks))
        if blocks[0]:
            left = held.select(F.col("id_a").alias("id"), F.col("cls_a").alias("cls")).union(held.select("id_b", "cls_b"))
            some = passing(some, *key, within=bitmap(left, *key, bits=bits), bits=bits)
        a, b = (some.select(F.col("id").alias(f"id_{x}"), F.col("cls").alias(f"cls_{x}"), "block", F.col("entries").alias(f"in_{x}")) for x in "ab")
        asked = held.select(*by, F.explode(F.array(*map(F.lit, blocks))).alias("block"))
        met = asked.join(a, ["id_a", "cls_a", "block"]).join(b, ["id_b", "cls_b", "block"])
        counts = {"more": F.size(F.array_intersect("in_a", "in_b")), "out_a": F.size("in_a"), "out_b": F.size("in_b")}
        met = met.select(*by, "block", *(c.cast("long").alias(k) for k, c in counts.items()))
        # A block counts once, however often its entries were read.
        sums = {k: sum(F.max(F.when(F.col("block") == block, F.col(k))) for block in blocks) for k in counts}
        counted = met.groupBy(*by).agg(*(c.alias(k) for k, c in sums.items()))
        counted = counted.select(*pair, (F.col("overlap") + F.col("more")).alias("overlap"), (F.col("left_a") - F.col("out_a")).alias("left_a"), (F.col("left_b") - F.col("out_b")).alias("left_b"))
        held = scratch.table(counted.filter(f"{100 + share} * (overlap + least(left_a, left_b)) >= {share} * (n_a + n_b)"))
    scratch.drop(inside, entries)
    return held.select("a", "b")


def ngram_classes(docs: DataFrame, n: int = 5, share: int = 80) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are ignored): doc_id, text_hash, n_grams, component_id, component.

    Texts are lower-cased for A-Z and cut into words at ASCII white space; a text's set holds its distinct n-word shingles, or with fewer
    words the whole sequence. Two documents link if 100 * overlap >= share * union; component_id is the least doc_id that links reach,
    component a number of its own for each component, and text_hash Spark's xxhash64 of the text.
    Texts that are null or have no word have no set and link with nothing. Rows that tie in doc_id are documents of their own; a null
    doc_id links as any other and is a component_id only where all of its component are null. No rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    late = spark.sparkContext.broadcast(_often(docs, n, scratch))
    rows = docs.mapInArrow(_prefixes(n, share, late), "doc_id long, text_hash long, n long, cls binary, first array<long>, places array<long>, sketch array<long>")
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()))
    late.destroy()
    del late  # else the driver holds the bits as long as there are rounds
    full = rows.filter("n > 0")
    classes = scratch.table(full.groupBy("cls").agg(F.min("doc_id").alias("lead"), F.min("row").alias("row"), F.count("*").alias("copies")))
    told = full.join(classes.select("row"), "row", "left_semi")
    roots = _roots(spark, scratch, docs, told, n, share)
    named = classes.select(F.col("row").alias("node"), "cls", "lead").join(roots, "node")
    least = named.groupBy("root").agg(F.min("lead").alias("least"))
    told = scratch.table(named.join(least, "root").select("cls", "root", "least"))
    wider = classes.join(told, "cls", "left").select("cls", F.coalesce("least", "lead").alias("component_id"), F.coalesce("root", "row").alias("component"), "copies")
    kept = ["doc_id", "text_hash", F.col("n").alias("n_grams"), "component_id", "component"]
    wider, slim = scratch.table(wider), scratch.table(rows.select("doc_id", "text_hash", "n", "cls", "row"))
    scratch.keep_only(wider, slim)
    linked = with_groups(slim.filter("n > 0").drop("row"), wider, "cls", "copies", scratch).select(*kept)
    alone = slim.filter("n = 0").withColumns({"component_id": F.col("doc_id"), "component": F.col("row")})
    return linked.unionByName(alone.select(*kept))


def _second_columns(wide: DataFrame, every: DataFrame, share: int, scratch: Scratch) -> DataFrame:
    """Entries (col, row, place, n, m, root) of pairs of columns: one of wide (col, row, place, n, root), the other of every; those whose rows have one
    root go. place is how many columns lie before the later one, without the other, which is the order of the pairs, too."""
    second = wide.join(every.select("row", F.col("col").alias("other"), F.col("place").alias("at")), "row").filter("col != other")
    later, place = F.greatest("col", "other"), F.greatest("place", "at") - 1
    second = second.select("row", "root", "n", F.xxhash64(F.least("col", "other"), later).alias("col"), later.alias("order"), place.alias("place")).distinct()
    sums = F.count("*").alias("m"), F.min("n").alias("least_n"), F.min("root").alias("a"), F.max("root").alias("b")
    columns = second.groupBy("col").agg(*sums).filter("a < b").select("col", "m", "least_n")
    held = second.join(columns, "col").filter(_reaches("n", "place", "least_n", share)).select("col", "row", "place", "n", "m", "root", "order")
    return _distinct_columns(scratch.table(held), scratch, "order")


def _roots(spark: SparkSession, scratch: Scratch, docs: DataFrame, lead: DataFrame, n: int, share: int) -> DataFrame:
    """(node, root) of the rows of lead, one for each class, that link with another."""
    # The entries of the product in columns that two rows share, with their places among their row's columns.
    every = _shared(lead.selectExpr("row", "n", "inline(arrays_zip(first, places)) AS (col, place)"), share, scratch)
    shared = _distinct_columns(every, scratch)
    told = scratch.table(lead.select("row", "cls", "doc_id", "n", "sketch").join(shared.select("row").distinct(), "row", "left_semi"))
    brief = told.select("row", "sketch")
    # First the partner that most columns name, one for each row.
    votes = shared.filter("row != first").groupBy("row", "first").agg(F.sum("same").alias("votes"))
    best = votes.groupBy(F.col("row").alias("a")).agg(F.max(F.struct("votes", F.col("first").alias("b"))).alias("v")).select("a", "v.b")
    tested = scratch.table(_within(best, told, share))
    links = _product(tested, docs, told, n, share, scratch)
    roots, longest = components(links, scratch), shared.agg(F.max("m")).first()[0] or 0
    # Where columns are parted, sets that reach the similarity must be met at the second column that they share, too; one entry lies before it.
    before = int(longest > LONG)
    held, pivots, parted, moved = shared, 0, False, True
    while pivots < longest:
        if moved:
            held = held.select("col", "row", "place", "n", "m").join(roots.select(F.col("node").alias("row"), "root"), "row", "left")
            held = scratch.table(held.withColumn("root", F.coalesce("root", "row")))
        # Columns whose rows have different roots, and were not counted in full before. Rows of a column's main root needn't ask, only answer.
        held = held.filter(F.col("m") > pivots)
        shares = held.groupBy("col", "root").agg(F.count("*").alias("k")).groupBy("col").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots"))
        open_ = shares.filter("roots > 1").select("col", "main")
        if pivots >= LONG and not parted:
            # Two sets that reach the similarity share two of their first columns and the next. If one of the two has no more rows than were pivots they
            # were compared there, so rows of a long column meet by it and another long one.
            wide = held.join(open_, "col", "left_semi").select("col", "row", "place", "n", "root")
            held = _second_columns(wide, every.filter(F.col("m") > pivots), share, scratch)
            pivots, parted, moved, before = 0, True, False, 0
            longest = held.agg(F.max("m")).first()[0] or 0
            continue
        pivots = max(1, pivots) * WIDEN
        chance = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) * F.col("m") < F.lit(pivots * (1 << 30))
        rest = held.join(open_, "col").filter((F.col("root") != F.col("main")) | chance)
        rest = rest.select("col", "row", "place", "n", "root", (F.col("root") != F.col("main")).alias("asks"), chance.alias("answers"))
        rest = scratch.table(rest.join(brief, "row"))
        if rest.isEmpty():
            return roots
        sides = [rest.filter(asked).select("col", *(F.col(c).alias(f"{c}_{x}") for c in ("row", "place", "root", "n", "sketch", other))) for x, asked, other in (("a", "asks", "answers"), ("b", "answers", "asks"))]
        # Before the first column that a pair shares, neither row can have so many that too few are left; this bounds the sizes, too. Rows that both ask meet once.
        met = sides[0].join(sides[1], "col").filter("row_a != row_b AND root_a != root_b AND (row_a < row_b OR NOT (answers_a AND asks_b))")
        met = met.filter(f"{100 + share} * ({before} + least(n_a - place_a, n_b - place_b)) >= {share} * (n_a + n_b)").filter(_near("n_a", "n_b", share))
        near = met.filter(_alike("sketch_a", "sketch_b", share)).select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()
        pairs = scratch.table(near.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
        scratch.drop(rest)
        moved = False
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            found = _product(pairs, docs, told, n, share, scratch)
            if moved := not found.isEmpty():
                links = scratch.table(links.unionByName(found))
                roots, held = components(links, scratch), held.join(open_, "col", "left_semi")
    return roots
