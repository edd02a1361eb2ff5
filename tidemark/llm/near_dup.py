"""MinHash near-duplicates by an inverted join on signature coordinates.

Texts with equal sets of word shingles are one class; what follows joins the classes. A class's signature has ``COORDINATES``
minima; it is posted under each (coordinate, value) pair. Two classes whose similarity is the threshold agree in fewer than
``matches_for(threshold)`` coordinates once in ten million times at most, so pairs with that many collisions are candidates. Pairs are
ordered by how often they occur: a pair of classes with enough collisions shares one of the ``COORDINATES - matches + 1`` rarest of either, so
only those prefixes are joined and the long lists of common passages are skipped.

No list of postings is turned into all its pairs. First a list's best-connected class is held against the others (a star);
what links to it is one component, and pairs inside a component need no look. While stars pay, each list's best class outside
its main component follows. Then classes outside the main component of a list are held against the others of the list. A pair is
left out where the shingles that a class shares with any other candidate are too few for the threshold, which is exact.
Candidates' whole shingle sets decide; no candidate is capped.

Lists longer than ``BLOCK`` that hold more than one in ``HOT`` of all postings are dealt in blocks, so that no list lands
in one task; there are at most ``HOT`` of those, which is what their broadcast is bounded by.

Components are found by passing on the least label and jumping along labels; each step is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import WordHash, drop_path, free_name, gram_hashes, materialise, mixed, odd_numbers, utf8
from tidemark.llm.tokens import forget

SHINGLE = 5
#: Two documents are linked if 100 times their common shingles reach SIMILAR times all of theirs.
SIMILAR = 85
#: The same where documents are taken away as near duplicates.
NEAR = 80
COORDINATES = 32
#: The chance at most that a pair at the threshold has too few collisions.
MISSED = 1e-7
#: Classes at most whose ids are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Star rounds go on while one in so many of the pairs held together is a link.
PAYS = 10
STARS = 8
#: Postings of a list that are dealt together at most, if the list has more than one in HOT of all postings.
BLOCK = 256
HOT = 10_000



def matches_for(similar: int) -> int:
    """The collisions asked for: as many as a pair of the least similarity falls short of with the chance MISSED at most."""
    p, short, m = similar / 100, 0.0, 0
    while m < COORDINATES and (short := short + comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) <= MISSED:
        m += 1
    return max(m, 1)


_GRAM = odd_numbers(SHINGLE, 4)
_MINIMA = odd_numbers(COORDINATES, 44)
_TAGS = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
_SALT = np.uint64(0xA5A5F00DCAFE1234)


def shingles(text: bytes, cache: WordHash) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes."""
    words = cache.of(text.lower().split())
    return np.unique(gram_hashes(words, min(SHINGLE, len(words)), _GRAM)) if len(words) else np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        return np.array([mixed(s).sum(), mixed(s ^ _SALT).sum()], np.uint64).tobytes()


def signature(s: np.ndarray) -> np.ndarray:
    """(coordinate, least value) pairs as numbers."""
    with np.errstate(over="ignore"):
        return np.array([(s * a).min() for a in _MINIMA], np.uint64) >> np.uint64(32) | _TAGS


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    cache = WordHash()
    for batch in batches:
        n, keys, sigs = [], [], []
        for t in batch.column(1):
            s = shingles(t.as_py() or b"", cache)
            n.append(len(s))
            keys.append(set_key(s) if len(s) else None)
            sigs.append(signature(s).astype(np.int64) if len(s) else None)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "key": pa.array(keys, pa.binary()), "sig": pa.array(sigs, pa.list_(pa.int64()))})


def _shingle_udf():
    @F.arrow_udf("struct<key:binary,h:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordHash()
        for texts in batches:
            sets = [shingles(t.as_py() or b"", cache) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "h"])

    return run.asNondeterministic()


def _similar_udf(similar: int):
    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache, last, held = WordHash(), None, None
        for ids, a, b in batches:
            out = []
            for i, x, y in zip(ids.to_pylist(), a, b):
                if i != last or held is None:
                    last, held = i, shingles(x.as_py(), cache)
                s = shingles(y.as_py(), cache)
                common = len(np.intersect1d(held, s, assume_unique=True))
                out.append(100 * common >= similar * (len(held) + len(s) - common))
            yield pa.array(out, pa.bool_())

    return run.asNondeterministic()


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) for the ends of the edges (a, b): the least id of each component. Tables of a step that the next has
    read are deleted."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        new = labels.join(heard, "id").select("id", F.least("label", "m").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("on"))
        before = labels
        labels = materialise(new.join(jump, "to").select("id", F.least("to", "on").alias("label"), (F.least("to", "on") != F.col("was")).alias("moved")), "labels")
        drop_path(edges.sparkSession, before.scratch_path)
        if not labels.filter("moved").limit(1).count():
            drop_path(edges.sparkSession, both.scratch_path)
            return labels.select("id", "label")


def _merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (id, comp) with the components that ``links`` (a, b) join made one."""
    at = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
    edges = materialise(links.join(at("a"), "a").join(at("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "joins")
    if not edges.limit(1).count():
        return comp
    labels = connected(edges)
    return materialise(comp.join(labels.select(F.col("id").alias("comp"), "label"), "comp", "left").select("id", F.coalesce("label", "comp").alias("comp")), "components")


def _verified(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Texts are picked by either end first, so what is dealt by
    ``a`` is the picked ones only; Spark splits a hot ``a`` and repeats its one text."""
    firsts = texts.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.col("text").alias("x"))
    seconds = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    both = seconds.join(firsts, "a")
    return both.withColumn("ok", _similar_udf(similar)("a", "x", "y")).filter("ok").select("a", "b")


def _possible(a: str, b: str, similar: int, matches: int) -> Column:
    """Whether two candidates can be similar enough: by the shingles that others have too, and by collisions."""
    c = lambda side, name: F.col(f"{side}_{name}")
    common = F.least(c(a, "n") - c(a, "u"), c(b, "n") - c(b, "u"))
    union = F.greatest(c(a, "n") + c(b, "u"), c(b, "n") + c(a, "u"))
    return (100 * common >= similar * union) & (F.size(F.array_intersect(c(a, "every"), c(b, "every"))) >= matches)


def _shared(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings (t, ...) of lists of two or more, with the list's length ``c`` and its number of blocks ``nb`` (1 but
    for hot lists), and (t, nb) of the hot lists: HOT at most, as each has more than one in HOT of all postings."""
    counts = materialise(posts.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "lists")
    every = counts.agg(F.sum("c")).first()[0] or 0
    hot = counts.filter((F.col("c") > BLOCK) & (F.col("c") * HOT > every)).withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("long"))
    hot = F.broadcast(materialise(hot, "hot"))
    cold = posts.join(hot.select("t"), "t", "left_anti").join(counts, "t").withColumn("nb", F.lit(1).cast("long"))
    return cold.unionByName(posts.join(hot, "t")), hot


def _blocks(df: DataFrame) -> DataFrame:
    """A row of ``df`` for each block of its list."""
    return df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))


def classes(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id of each document (doc_id, text).

    Texts without words, and null ones, have no shingles and are linked with nothing; with fewer words than a shingle the
    whole text is one. The component is the least doc_id reached. A null doc_id takes part in its class but is never the
    least; a class or component of null ids only has a null component. Repeated rows are copies of each other.
    """
    matches = matches_for(similar)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text").cast("string")).alias("text"))
    signed = materialise(rows.mapInArrow(_sign, "doc_id long, n long, key binary, sig array<long>"), "signatures")
    known = signed.filter("key is not null").groupBy("key", "n")
    own = materialise(known.agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")).filter("rep is not null"), "classes")
    # postings: how often each pair of coordinate and value occurs; those that occur once meet nothing
    posted = own.select("key", F.explode("sig").alias("t"))
    per = _shared(posted)[0].groupBy("key").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("s"), F.sum("c").alias("score"))
    per = per.filter(F.size("s") >= matches).join(own.select("key", "n", "rep"), "key")
    candidates = materialise(
        per.select(F.monotonically_increasing_id().alias("id"), "key", "n", "rep", "score", F.transform("s", lambda x: x["t"]).alias("every"), F.transform(F.slice("s", F.lit(1), F.size("s") - (matches - 1)), lambda x: x["t"]).alias("prefix")),
        "candidates",
    )
    ids = candidates.select("id", "key", F.col("rep").alias("doc_id"))
    if candidates.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    cut = _shingle_udf()
    texts = materialise(rows.join(ids, "doc_id").withColumn("s", cut("text")).filter("s.key = key").select("id", "text", F.col("s.h").alias("h")), "texts")
    # shingles of one candidate only can't be common to a pair
    alone = texts.select("id", F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    sets, texts = texts.select("id", "h"), texts.select("id", "text")
    able = candidates.join(alone, "id", "left").withColumn("u", F.coalesce("u", F.lit(0))).filter(100 * (F.col("n") - F.col("u")) >= similar * F.col("n"))
    posts = able.select("id", "n", "u", "score", "every", "prefix", F.explode("prefix").alias("t"))
    posts = _shared(posts)[0].drop("c")
    posts = materialise(posts.withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb"))), "postings")
    side = lambda df, s: df.select(*[F.col(c).alias(c if c in ("t", "block") else f"{s}_{c}") for c in df.columns])
    comp = materialise(posts.select("id", F.col("id").alias("comp")).distinct(), "components")
    used = None
    rank = F.struct("score", (-F.col("id")).alias("least"), "comp")
    for _ in range(STARS):
        now = posts.join(comp, "id")
        home = now.groupBy("t").agg(F.max(rank).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("t", "top")
        if used is None:
            centers = home.select("t", (-F.col("top.least")).alias("id"))
        else:
            rest = now.join(home, "t").filter(F.col("comp") != F.col("top.comp")).join(used, ["t", "id"], "left_anti")
            centers = rest.groupBy("t").agg(F.max(rank).alias("best")).select("t", (-F.col("best.least")).alias("id"))
        centers = materialise(centers, "centers")
        used = centers if used is None else used.unionByName(centers)
        left, right = side(_blocks(now.join(centers, ["t", "id"])), "p"), side(now.drop("prefix"), "q")
        met = left.join(right, ["t", "block"]).filter((F.col("p_comp") != F.col("q_comp")) & _possible("p", "q", similar, matches))
        pairs = materialise(met.select(F.col("p_id").alias("a"), F.col("q_id").alias("b")).distinct(), "stars")
        links = materialise(_verified(pairs, texts, similar), "links")
        comp = _merge(comp, links)
        if links.count() * PAYS < pairs.count() or not pairs.limit(1).count():
            break
    # whatever is left: the classes outside a list's main component against the others of the list; a pair belongs to the
    # least of the postings that it shares. Whole sets are compared in the join, so that only links leave it.
    now = posts.join(comp, "id")
    home = now.groupBy("t").agg(F.max(rank).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("t", F.col("top.comp").alias("home"))
    now = materialise(now.join(home, "t").join(sets, "id"), "rest")
    left, right = side(_blocks(now.filter("comp <> home")), "p"), side(now, "q")
    met = left.join(right, ["t", "block"]).filter(
        (F.col("p_comp") != F.col("q_comp"))
        & ((F.col("q_comp") == F.col("q_home")) | (F.col("p_id") < F.col("q_id")))
        & _possible("p", "q", similar, matches)
        & (F.array_min(F.array_intersect("p_prefix", "q_prefix")) == F.col("t"))
        & ((100 + similar) * F.size(F.array_intersect("p_h", "q_h")) >= similar * (F.size("p_h") + F.size("q_h")))
    )
    comp = _merge(comp, materialise(met.select(F.col("p_id").alias("a"), F.col("q_id").alias("b")), "links"))
    reps = candidates.select("id", "key", "rep").join(comp, "id")
    least = reps.groupBy("comp").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    joined = reps.join(least, "comp").select("key", "component")
    of_key = own.select("key", "rep", "copies").join(joined, "key", "left").filter("copies > 1 or component is not null")
    of_key = materialise(of_key.select("key", F.coalesce("component", "rep").alias("component")), "members")
    out = signed.select("doc_id", "n", "key").join(of_key, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; a null id is kept where its component is null."""
    return classes(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, similar: int = NEAR) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; columns as they were. Rows with a null id
    stay, and rows that repeat a kept id stay together."""
    gone = materialise(classes(docs, similar).filter("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    name = free_name(docs, "_gone")
    return docs.join(gone.withColumnRenamed("doc_id", name), F.col("doc_id") == F.col(name), "left_anti")
