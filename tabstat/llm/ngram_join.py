"""Operator 4: n-gram Jaccard join by MinHash banding.

Texts become sets of hashed word five-grams (a text of one to four words is
one gram). Documents with equal sets are one node, so copies are counted, not
paired. Band and row counts are chosen for the target recall at the threshold;
nodes are shuffled on band hashes and each bucket links its members to its
least member, a linear number of edges. Connected buckets form candidate
clusters. The full sets of a cluster meet in blocks of bounded size and every
pair of a block is verified on the full sets; only counts and a spanning
forest leave a block. Verified links are joined to classes.

Cases: a text without words (null, empty) has no grams, is its own class and
has no link; equal texts and equal sets are links of similarity 1; repeated
rows count as separate documents; null ids never name a class unless all its
ids are null; empty tables give empty results; further columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import words as W
from .shared import components, identity, sized_by

GRAM = 5
THRESHOLD = (4, 5)
RECALL = 0.9999
BLOCK = 2048  # sets that meet in one task, for each side
BLOCK_GRAMS = 1 << 20  # and the grams they may hold


def choose_bands(threshold: float, recall: float, rows: int | None = None) -> tuple[int, int]:
    """(bands, rows): most rows whose band count stays at 32 or less; a pair
    at the threshold is missed with probability 1 - recall at most."""
    best = (1, 1)
    for r in [rows] if rows else range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**r)))
        if bands > 32 and not rows:
            break
        best = (bands, r)
    return best


def gram_sets(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, gram) of a chunk: arrays of text numbers, grams."""
    h, at = W.grams(w, k)
    h2, docs = W.short_grams(w, k)
    doc = np.concatenate([w.doc[at], docs])
    h = np.concatenate([h, h2])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
    return doc, h


def _sketch(w: W.Words, k: int, bands: int, rows: int):
    """Per text: 16-byte set fingerprint or None, set size, band hashes."""
    doc, h = gram_sets(w, k)
    present, heads = np.unique(doc, return_index=True)
    prints: list[bytes | None] = [None] * w.n
    sizes = np.zeros(w.n, np.int64)
    sig = np.zeros((w.n, bands), np.uint64)
    if len(present):
        sizes[present] = np.diff(np.append(heads, len(h)))
        sums = np.stack([np.add.reduceat(W.mix(h ^ c), heads) for c in W.constants(2, 11)], axis=1).astype("<u8")
        raw = sums.tobytes()
        for i, d in enumerate(present.tolist()):
            prints[d] = raw[16 * i : 16 * i + 16]
        mult, add, fold = (W.constants(bands * rows, s) for s in (13, 17, 19))
        for b in range(bands):
            band = np.full(len(present), b, np.uint64)
            for r in range(b * rows, b * rows + rows):
                band += np.minimum.reduceat((h ^ add[r]) * mult[r], heads) * fold[r]
            sig[present, b] = W.mix(band)
    return prints, sizes, sig


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, k1, k2, fp, n, bands) of every row of docs."""
    slim = docs.select(F.col(id_col).alias("id"), *identity(F.col(id_col), F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType()),
                           T.StructField("fp", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for w in W.cut(batch.column(3)):
                prints, sizes, sig = _sketch(w, k, bands, rows)
                flat = pa.array(sig.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(w.n + 1) * bands, pa.int32()), flat)
                part = batch.slice(w.first, w.n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(prints, pa.binary()), pa.array(sizes), lists],
                                                 names=schema.names)

    return slim.mapInArrow(run, schema)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(root, fp, copies, place columns, grams) from rows with a text."""
    rest = [f for f in texts.schema.fields if f.name != "text"]
    at = texts.columns.index("text")

    def run(batches):
        for batch in batches:
            for w in W.cut(batch.column(at)):
                doc, h = gram_sets(w, k)
                ends = np.searchsorted(doc, np.arange(w.n + 1))
                raw = [h[a:b].astype("<u8").tobytes() for a, b in zip(ends[:-1], ends[1:])]
                part = batch.slice(w.first, w.n)
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in rest] + [pa.array(raw, pa.binary())],
                                                 names=[f.name for f in rest] + ["grams"])

    return texts.mapInArrow(run, T.StructType([*rest, T.StructField("grams", T.BinaryType())]))


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of the sets of a (rows) and of b (columns)."""
    if len(a) * len(b) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.float32).reshape(len(a), len(b))
    out = np.zeros((len(a), len(b)), np.float32)
    whole = [np.concatenate(s) for s in (a, b)]
    common = np.intersect1d(*whole)
    sides = []
    for sets, values in zip((a, b), whole):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        keep = common[column] == values if len(common) else np.zeros(len(values), bool)
        owner, column = owner[keep], column[keep]
        order = np.argsort(column, kind="stable")
        sides.append((owner[order], column[order]))
    for lo in range(0, len(common), 4096):
        m = []
        for (owner, column), sets in zip(sides, (a, b)):
            x, y = np.searchsorted(column, [lo, lo + 4096])
            part = np.zeros((len(sets), min(4096, len(common) - lo)), np.float32)
            part[owner[x:y], column[x:y] - lo] = 1
            m.append(part)
        out += m[0] @ m[1].T
    return out


def links_of_block(a: list[int], b: list[int], sets: list[np.ndarray], copies: np.ndarray, threshold: tuple[int, int]):
    """(links, parent) per member of a block: verified links between the
    members a and the members b (the same list: all pairs in it), weighted by
    the partner's copies, and a spanning forest over them."""
    size = np.array([len(s) for s in sets], np.float32)
    common = shared_counts([sets[i] for i in a], [sets[i] for i in b])
    near = common * threshold[1] >= (size[a][:, None] + size[b][None, :] - common) * threshold[0]
    same = a is b
    if same:
        np.fill_diagonal(near, False)
    links = np.zeros(len(sets), np.int64)
    links[a] += near @ copies[b]
    if not same:
        links[b] += near.T @ copies[a]
    parent = np.arange(len(sets))
    rows, cols = np.array(a), np.array(b)
    seen = np.zeros(len(sets), bool)
    at_row, at_col = np.full(len(sets), -1), np.full(len(sets), -1)
    at_row[rows], at_col[cols] = np.arange(len(a)), np.arange(len(b))
    for start in np.flatnonzero(links).tolist():
        if seen[start]:
            continue
        seen[start], todo = True, [start]
        while todo:
            x = todo.pop()
            met = [cols[near[at_row[x]]]] if at_row[x] >= 0 else []
            if not same and at_col[x] >= 0:
                met.append(rows[near[:, at_col[x]]])
            more = np.concatenate(met)
            more = more[~seen[more]]
            seen[more] = True
            parent[more] = start
            todo += more.tolist()
    return links, parent


def _verify(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(fp, parent, links) of each block; rows: (block, cross, side, fp, copies, grams)."""
    schema = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("parent", T.BinaryType()), T.StructField("links", T.LongType())])

    def solve(group):
        unique = {x["fp"]: x for x in group}  # a repeated row brings its set again
        group = list(unique.values())
        if len(group) < 2:
            return None
        sets = [np.frombuffer(x["grams"], "<u8") for x in group]
        a = b = list(range(len(group)))
        if group[0]["cross"]:
            a = [i for i in b if group[i]["side"] == group[0]["side"]]
            b = [i for i in b if group[i]["side"] != group[0]["side"]]
            if not b:
                return None
        links, parent = links_of_block(a, b, sets, np.array([x["copies"] for x in group]), threshold)
        has = np.flatnonzero(links)
        if not len(has):
            return None
        return pa.RecordBatch.from_arrays([
            pa.array([group[i]["fp"] for i in has], pa.binary()), pa.array([group[parent[i]]["fp"] for i in has], pa.binary()),
            pa.array(links[has], pa.int64())], names=schema.names)

    def run(batches):
        group: list[dict] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for x in batch.slice(lo, 64).to_pylist():
                    if group and group[0]["block"] != x["block"]:
                        if (out := solve(group)) is not None:
                            yield out
                        group = []
                    group.append(x)
        if group and (out := solve(group)) is not None:
            yield out

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def _blocks(cand: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Block places of each candidate node: cand (fp, root, n, copies) plus
    ``places``, an array of (block, cross, side).

    A cluster that fits one block is one. A larger one is cut by set size (two
    sets can only reach the threshold if their size classes are equal or
    adjacent) and by hash; every two blocks that can hold a link meet once.
    """
    step = math.log(threshold[1] / threshold[0] * 1.0001)
    whole = cand.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("grams"))
    cand = cand.join(whole, "root").withColumn(
        "cls", F.when((F.col("members") <= BLOCK) & (F.col("grams") <= BLOCK_GRAMS), F.lit(-9)).otherwise(F.floor(F.log(F.col("n")) / step).cast("int")))
    classes = cand.groupBy("root", "cls").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("m"))
    up = classes.select("root", (F.col("cls") - 1).alias("cls"), F.col("m").alias("m_up"))
    down = classes.select("root", (F.col("cls") + 1).alias("cls"), F.col("m").alias("m_down"))
    classes = classes.join(up, ["root", "cls"], "left").join(down, ["root", "cls"], "left").na.fill(0, ["m_up", "m_down"])
    own = "int(pmod(xxhash64(fp), m))"  # the type of j: equal numbers of two types have unequal hashes
    key = "xxhash64(root, cls, {a}, {b}, '{kind}')"
    places = F.expr(f"""flatten(array(
        transform(sequence(0, m - 1), j -> named_struct('block', {key.format(a=f'least({own}, j)', b=f'greatest({own}, j)', kind='same')}, 'cross', {own} <> j, 'side', {own})),
        transform(if(m_up > 0, sequence(0, m_up - 1), array()), j -> named_struct('block', {key.format(a=own, b='j', kind='next')}, 'cross', true, 'side', -1)),
        transform(if(m_down > 0, sequence(0, m_down - 1), array()), j -> named_struct('block', {key.replace('cls', 'cls - 1').format(a='j', b=own, kind='next')}, 'cross', true, 'side', -2))))""")
    return cand.join(classes, ["root", "cls"]).withColumn("places", places).select("root", "fp", "n", "copies", "places")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM,
                    threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: id, k1, k2 (row identity), class_id, n_links
    (other documents of similarity ``threshold`` or more), n_grams."""
    bands, rows = choose_bands(threshold[0] / threshold[1], recall)
    sk = materialize(sketches(docs, id_col, text_col, k, bands, rows), "sketches")
    nodes = sk.where("fp is not null").groupBy("fp").agg(
        F.count("*").alias("copies"), F.min("id").alias("least_id"), F.min(F.struct("k1", "k2")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")

    banded = nodes.select("fp", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("fp").alias("least"), F.count("*").alias("members")).where("members > 1").drop("members")
    near = components(banded.join(buckets, "band").select("fp", "least"), "fp", "least")
    cand = nodes.drop("bands").join(near.select(F.col("node").alias("fp"), "root"), "fp")
    cand = materialize(_blocks(cand.select("fp", "root", "n", "copies"), threshold).join(nodes.select("fp", "one.*"), "fp"), "candidates")

    texts = docs.select(*identity(F.col(id_col), F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    # a node of a large cluster has a place per block
    wanted = sized_by(cand.select("k1", "k2", "fp", "copies", "places"), 64 + 40 * F.size("places"))
    rows_in = _sets(texts.join(wanted, ["k1", "k2"]).select("fp", "copies", "places", "text"), k)
    rows_in = rows_in.select("fp", "copies", "grams", F.explode("places").alias("p")).select("p.block", "p.cross", "p.side", "fp", "copies", "grams")
    found = materialize(_verify(rows_in, threshold), "links")

    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    classes = components(found.select("fp", "parent"), "fp", "parent").select(F.col("node").alias("fp"), "root")
    named = classes.join(nodes.select("fp", "least_id"), "fp")
    names = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    per_node = nodes.select("fp", "copies", "least_id").join(links, "fp", "left").join(classes.join(names, "root"), "fp", "left")
    per_node = per_node.select("fp", F.coalesce("root", "fp").alias("class_key"), F.coalesce("class_id", "least_id").alias("class_id"),
                               (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sk.select("id", "k1", "k2", "fp", "n").join(per_node, "fp", "left")
    return out.select(F.col("id").alias(id_col), "k1", "k2", "class_key", F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n").alias("n_grams"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with one document of each class, the one with the
    least id (null last); of repeated rows one stays; documents without grams
    all stay."""
    classes = materialize(jaccard_classes(docs, id_col, text_col, **options), "classes")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), "k1", "k2")
    kept = classes.where("class_key is not null").groupBy("class_key").agg(F.min(order).alias("s")).select("s.k1", "s.k2", F.lit(True).alias("single"))
    kept = kept.union(classes.where("class_key is null").select("k1", "k2", F.lit(False)).distinct())
    kept = materialize(kept, "kept")
    keys = identity(F.col(id_col), F.col(text_col))
    joined = docs.select("*", keys[0].alias("__k1"), keys[1].alias("__k2")).join(
        kept.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("single").alias("__single")), ["__k1", "__k2"])
    # of rows that repeat id and text, the one with the least hash; an
    # aggregate, so that very many of them meet pre-aggregated
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = joined.where("__single").groupBy("__k1", "__k2").agg(F.min_by(row, F.xxhash64(row)).alias("__row"))
    once = once.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
    return once.unionByName(joined.where("NOT __single").select(*docs.columns))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_classes(docs).select("doc_id", "class_id", "n_links", "n_grams")
