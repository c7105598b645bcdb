"""Near copies by MinHash: documents whose sets of word shingles overlap by three quarters.

Words are runs without white space, A-Z in lower case; a document's set holds its distinct
shingles of five words, or its whole sequence when it has fewer. Documents are linked when
``100 * intersection >= 75 * union``; a component is what links reach.

Method: a signature of ``COORDINATES`` minima; documents are posted under coordinate-value pairs, so
many of them that any two with ``MATCHES`` collisions meet. A pair at the threshold has fewer collisions
with probability 4e-8, one above it with less. Pairs that meet are not sorted out by counting the rest of
their collisions: bounds on the overlap rule most of them out, and links are confirmed on full sets.

* Equal sets are one class first, so copies never meet each other.
* Skip: a pair that nobody else has cannot collide. A document with fewer than ``MATCHES`` shared
  pairs is left out, and so is one of which over a quarter of the shingles occurs nowhere else.
* Prefix: of ``c`` shared pairs, ordered by how common they are, only the ``c - MATCHES + 1``
  rarest are posted; two documents with ``MATCHES`` collisions share one of them.
* A posting list is not expanded into pairs. Its members first meet one leader, the member with
  the largest share of shingles that others have too, then (twice) one picked by hash. Only members
  of different components are compared one by one, each pair under its first common post, and only
  if its overlap can reach the threshold: it is bounded by the shingles that each has in common
  with any other document, and by what both share with, and have beside, a common leader.

The pairwise step looks at pairs of a list that are still apart; with many unlinked documents in
one list its time grows with their number squared, its output doesn't.

Texts without words (null, empty) have an empty set and no links. Rows that repeat a ``doc_id``
are answered by their own text; where their texts differ and no other document has them, one text
(that of the smallest set hash) takes part in links between different sets. A null ``doc_id`` takes its text's
component if other rows have it, else null, and is kept. An empty table gives no rows; other
columns are ignored by ``components`` and kept by ``without_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import narrow, ship, stored, text_or_empty, without

WORDS = 5
THRESHOLD_PERCENT = 75
COORDINATES = 48
MATCHES = 19
LEADER_ROUNDS = 3
SEED = 20240229
#: Documents whose shingles a worker unpacks together.
AT_ONCE = 256
#: Shingles hashed against all coordinates at a time.
BLOCK = 4096

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The set of shingles as ascending 64-bit hashes."""
    words = text.encode().lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    count = len(words) - width + 1
    combined = hashes[:count].copy()
    for at in range(1, width):
        combined = combined * _STEP + hashes[at : at + count]
    return np.unique(_mixed(combined + np.uint64(width)))


def _coordinates() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)
    return factors[:, None], rng.integers(0, 2**64, COORDINATES, dtype=np.uint64)[:, None]


def signature(found: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """One number per coordinate: its index in the high half, its 32-bit minimum in the low half."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (factors * found[at : at + BLOCK] + terms).min(axis=1))
    return ((np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | (least >> np.uint64(32))).astype(np.int64)


def _set_hash(packed: bytes) -> bytes:
    return blake2b(packed, digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_md5, n_shingles, set_hash, signature``; the last two are null without words."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, terms = _coordinates()
        for batch in batches:
            sizes, hashes, signed = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                sizes.append(len(found))
                hashes.append(_set_hash(found.tobytes()) if len(found) else None)
                signed.append(signature(found, factors, terms) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(signed, pa.list_(pa.int64()))],
                names=["doc_id", "text_md5", "n_shingles", "set_hash", "signature"],
            )

    return docs.select("doc_id", text_or_empty().alias("text"), F.md5(text_or_empty()).alias("text_md5")).mapInArrow(
        sign, f"doc_id {kind}, text_md5 string, n_shingles bigint, set_hash binary, signature array<bigint>"
    )


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, hashes`` (ascending, packed) of the documents and sets in ``ids`` (``doc_id, set_hash``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [shingles(text.as_py()).tobytes() for text in batch.column(1)]
            asked = [_set_hash(found) == expected.as_py() for found, expected in zip(packed, batch.column(2))]
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "hashes"])
            yield found.filter(pa.array(asked, pa.bool_()))

    chosen = docs.select("doc_id", text_or_empty().alias("text")).join(narrow(ids), "doc_id")
    return chosen.mapInArrow(hashed, f"doc_id {kind}, hashes binary")


def _unpacked(sets: DataFrame) -> DataFrame:
    """``doc_id, shingle`` rows."""
    kind = sets.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = [np.frombuffer(packed.as_py(), np.int64) for packed in part.column(1)]
                row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                ids = part.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found))], names=["doc_id", "shingle"])

    return sets.mapInArrow(rows, f"doc_id {kind}, shingle bigint")


def _alone(members: DataFrame, value: str) -> DataFrame:
    """``doc_id, alone``: how many of a document's values no other document has."""
    once = members.groupBy(value).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    return once.groupBy("doc_id").agg(F.count("*").alias("alone"))


def _reachable(n_a: Column, n_b: Column, overlap: Column) -> Column:
    """Whether sets of these sizes with at most this overlap can be linked."""
    return (100 + THRESHOLD_PERCENT) * overlap >= THRESHOLD_PERCENT * (n_a + n_b)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with ``n_a, n_b, overlap``: sizes of the full sets and of their intersection."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for one, other in zip(batch.column(2), batch.column(3)):
                left, right = (np.frombuffer(packed.as_py(), np.uint64) for packed in (one, other))
                both = np.concatenate([left, right])
                both.sort(kind="stable")
                sizes.append((len(left), len(right), int(np.count_nonzero(both[1:] == both[:-1]))))
            counted = [pa.array(x, pa.int64()) for x in zip(*sizes)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counted], names=["a", "b", "n_a", "n_b", "overlap"])

    of_a = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("hashes_a"))
    of_b = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hashes_b"))
    kind = sets.schema["doc_id"].dataType.simpleString()
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(
        count, f"a {kind}, b {kind}, n_a bigint, n_b bigint, overlap bigint"
    )


def _linked(overlaps: DataFrame) -> DataFrame:
    return overlaps.filter(_reachable(F.col("n_a"), F.col("n_b"), F.col("overlap"))).select("a", "b")


def connected(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, component`` with components joined along ``links`` (``a, b``, documents).

    Every component takes the smallest one next to it, then the one which that has taken, until
    nothing changes. Only the components that links touch are worked on; each round is stored.
    """
    label = labels.select(F.col("doc_id").alias("a"), F.col("component").alias("x"))
    other = labels.select(F.col("doc_id").alias("b"), F.col("component").alias("y"))
    edges = links.join(label, "a").join(other, "b").filter("x != y").select("x", "y")
    edges = stored(edges.union(edges.select("y", "x")).distinct(), "edges")
    if edges.isEmpty():
        return labels
    roots = stored(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("root")), "roots")
    while True:
        # the root of each neighbour, and the root of the own root
        near = edges.join(roots.select(F.col("node").alias("y"), F.col("root").alias("near")), "y").select(
            F.col("x").alias("node"), "near"
        )
        far = roots.alias("own").join(roots.alias("next"), F.col("own.root") == F.col("next.node")).select(
            F.col("own.node"), F.col("next.root").alias("near")
        )
        # a root takes what its members have found
        found = near.union(far)
        members = roots.join(found, "node").select(F.col("root").alias("node"), "near")
        least = found.union(members).groupBy("node").agg(F.min("near").alias("near"))
        new = stored(
            roots.join(least, "node").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved")),
            "roots",
        )
        moved = not new.filter("moved").isEmpty()
        roots = new.drop("moved")
        if not moved:
            break
    joined = labels.join(roots.withColumnRenamed("node", "component"), "component", "left")
    return stored(joined.select("doc_id", F.coalesce("root", "component").alias("component")), "components")


def _leader_pairs(posts: DataFrame, order: Column) -> DataFrame:
    """Each document with one leader of another component: of its lists' leaders the most frequent."""
    facts = F.struct("doc_id", "component", "n_shingles", "shared")
    leaders = stored(posts.groupBy("post").agg(F.min(F.struct(order.alias("order"), facts.alias("of")))["of"].alias("leader")), "leaders")
    met = posts.join(leaders, "post").filter(
        (F.col("component") != F.col("leader.component"))
        & _reachable(F.col("n_shingles"), F.col("leader.n_shingles"), F.least("shared", "leader.shared"))
    )
    often = met.groupBy("doc_id", F.col("leader.doc_id").alias("b")).agg(F.count("*").alias("n"))
    best = often.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("fewer"), "b"))["b"].alias("b"))
    return best.select(F.col("doc_id").alias("a"), "b")


def _rest(posts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pairs of documents that are still apart and may be linked; each under its first common post."""
    facts = stored(posts.join(anchors, "doc_id", "left").select(
        "post", "doc_id", "component", "n_shingles", "shared", "prefix", F.coalesce("anchor", "doc_id").alias("anchor"),
        F.coalesce("anchored", "n_shingles").alias("anchored"),
        # beside the anchor and not the document's alone
        F.coalesce(F.col("shared") - F.col("anchored"), F.lit(0)).alias("beside"),
    ), "posts-apart")
    a, b = facts.alias("a"), facts.alias("b")
    n_a, n_b = F.col("a.n_shingles"), F.col("b.n_shingles")
    bound = F.least("a.anchored", "b.anchored") + F.greatest(F.lit(0), F.least("a.beside", "b.beside"))
    may_be = (
        (F.col("a.post") == F.col("b.post"))
        & (F.col("a.doc_id") < F.col("b.doc_id"))
        & (F.col("a.component") != F.col("b.component"))
        & _reachable(n_a, n_b, F.least("a.shared", "b.shared"))
        & ((F.col("a.anchor") != F.col("b.anchor")) | _reachable(n_a, n_b, bound))
        & (F.array_min(F.array_intersect("a.prefix", "b.prefix")) == F.col("a.post"))
    )
    return a.join(b, may_be).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))


def links_and_labels(docs: DataFrame, signed: DataFrame, firsts: DataFrame) -> DataFrame:
    """``doc_id, component`` of one document of each set that has links to other sets."""
    one_set = firsts.groupBy(F.col("first").alias("doc_id")).agg(F.min("set_hash").alias("set_hash"))
    classes = stored(signed.filter("n_shingles > 0").join(one_set, ["doc_id", "set_hash"]), "set-classes")

    def pairs_of(of: DataFrame) -> DataFrame:
        return of.select("doc_id", F.explode("signature").alias("post"))

    sharing = classes.join(_alone(pairs_of(classes), "post"), "doc_id", "left").filter(
        COORDINATES - F.coalesce("alone", F.lit(0)) >= MATCHES
    )
    sharing = stored(sharing.drop("alone"), "sharing-pairs")
    sets = stored(full_sets(docs, sharing.select("doc_id", "set_hash").distinct()), "full-sets")
    shared = F.col("n_shingles") - F.coalesce("alone", F.lit(0))
    similar = stored(
        sharing.join(_alone(_unpacked(sets), "shingle"), "doc_id", "left")
        .withColumn("shared", shared)
        .filter(100 * shared >= THRESHOLD_PERCENT * F.col("n_shingles"))
        .drop("alone"),
        "sharing-shingles",
    )
    often = stored(pairs_of(similar).groupBy("post").agg(F.count("*").alias("n")).filter("n > 1"), "common-pairs")
    gathered = (
        pairs_of(similar)
        .join(often, "post")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "post")))["post"].alias("ordered"))  # at most COORDINATES
        .filter(F.size("ordered") >= MATCHES)
    )
    prefix = F.slice("ordered", F.lit(1), F.size("ordered") - MATCHES + 1)
    prefixes = stored(similar.join(gathered, "doc_id").select("doc_id", "n_shingles", "shared", prefix.alias("prefix")), "prefixes")
    labels = prefixes.select("doc_id", F.col("doc_id").alias("component")).distinct()
    anchors = None
    for number in range(LEADER_ROUNDS):
        posts = stored(prefixes.join(labels, "doc_id").select("*", F.explode("prefix").alias("post")).drop("prefix"), "posts")
        order = -F.col("shared") / F.col("n_shingles") if number == 0 else F.xxhash64("doc_id", F.lit(number)).cast("double")
        overlaps = stored(_overlaps(_leader_pairs(posts, order), sets), "overlaps")
        if anchors is None:
            anchors = overlaps.select(F.col("a").alias("doc_id"), F.col("b").alias("anchor"), F.col("overlap").alias("anchored"))
        labels = connected(labels, _linked(overlaps))
    apart = prefixes.join(labels, "doc_id").select("*", F.explode("prefix").alias("post"))
    pairs = stored(_rest(apart, anchors), "pairs-apart")
    return connected(labels, _linked(_overlaps(pairs, sets)))


def judged(docs: DataFrame) -> DataFrame:
    """:func:`components` beside the ``text_md5`` of the text each row is about."""
    signed = stored(signatures(docs), "signatures")
    firsts = stored(
        signed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("first")), "set-firsts"
    )
    labels = links_and_labels(docs, signed.drop("text_md5"), firsts)
    # the smallest id of a component is that of its smallest set's first document
    named = stored(firsts.join(labels.withColumnRenamed("doc_id", "first"), "first").select("set_hash", "component"), "set-components")
    of_set = stored(firsts.join(named, "set_hash", "left").select("set_hash", F.coalesce("component", "first").alias("component")), "sets")
    component = F.coalesce("component", "doc_id")
    return signed.drop("signature").join(of_set, "set_hash", "left").select(
        "doc_id", "text_md5", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    return judged(docs).drop("text_md5")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the first of each component, with all columns."""
    gone = judged(docs).filter("NOT kept").select("doc_id", F.col("text_md5").alias("digest"))
    return without(docs, gone, F.md5(text_or_empty()))
