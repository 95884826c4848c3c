"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct five-word shingles (tokens). Two sets link when their Jaccard similarity is at least
``percent`` / 100. Equal sets are one class, so copies never form pairs. The filter is exact:

* Tokens of more than ``FREQUENT`` documents are the frequent class. Every set is ordered rare tokens first, frequent tokens
  last, by hash inside; any global order is right, this one keeps common passages out of the prefixes, and a rare token meets
  at most ``FREQUENT`` documents.
* Two linked sets share a token among their first p = n - ceil(t n) + 1 tokens. Rare tokens of the prefix are indexed by themselves.
* Sets whose prefix reaches into the frequent tokens extend it to all of these. If two such sets link without a common rare token, all
  they share is frequent, and so many must be shared that the frequent parts differ in at most H = s(x) + s(y) tokens, where
  s = n (1 - t) / (1 + t) - r and r counts the rare tokens. Frequent tokens are dealt into H + 1 subclasses by hash, so the two agree in
  all tokens of one subclass: the combination of all a set has of a subclass is indexed, k tokens where few may differ and a set is
  long, fewer where more may differ. s falls into ranges; a set is indexed for each range that a partner's can be in.

Signatures with the same members are one. Their documents are compared to one leader first. What links joins its component; only members of different
components need a look at each other, so a group of near copies costs its size and not its square. That look compares sizes and a
bitmap of parities inside the join, which never loses a link; what passes is verified on the whole sets.

Empty and null texts have no tokens and link with nothing; a text of fewer than five words is one token. Rows without an id
get no component. Rows that share an id are one node, linked where any of their texts links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sealcheck.llm import common, textscan

PERCENT = 80
#: A token of more documents than this is frequent.
FREQUENT = 16
#: Frequent tokens that are broadcast at most (8 bytes each); beyond it they are joined.
BROADCAST_TOKENS = 1 << 20
#: Pairs whose ids (twice 8 bytes each) are broadcast at most.
BROADCAST_PAIRS = 500_000
#: Looks at a leader outside the largest component, before members of different components are compared; the last round is that comparison.
ROUNDS = 2
BITMAP_LONGS = 16
#: Text bytes whose tokens share a bucket when tokens are counted; tokens a task counts before it hands them on.
BUCKET_BYTES, PARCEL_TOKENS = 8 << 20, 400_000

_SALT_A, _SALT_B = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LONGS = T.ArrayType(T.LongType())


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _range_starts(limit: int = 1 << 26) -> np.ndarray:
    """Starts of the ranges of s: single numbers around zero, then a quarter wider each."""
    up = [0]
    while up[-1] < limit:
        up.append(up[-1] + max(1, up[-1] // 4))
    return np.array([*(-u for u in up[:0:-1]), *up], np.int64)


_STARTS = _range_starts()


def _range_of(value: int) -> int:
    return int(np.searchsorted(_STARTS, value, "right")) - 1


def combinations(tokens: np.ndarray, n: int, percent: int = PERCENT) -> list[np.ndarray]:
    """Signatures of the frequent ``tokens`` of a set of ``n``, per range of s that a partner can be in."""
    unit = 100 + percent
    own = _range_of((n * (100 - percent) - (n - len(tokens)) * unit) // unit)
    largest = (n * 100 // percent) * (100 - percent) // unit
    top = int(_STARTS[own + 1]) - 1
    values = textscan.mix(tokens ^ _SALT_A)
    # sums of 24 bits of up to 2**29 tokens are exact in doubles
    parts = [((values >> shift & np.uint64(2**24 - 1)).astype(float), shift) for shift in (np.uint64(0), np.uint64(32))]
    found = []
    for other in range(_range_of(-top - 1), _range_of(largest) + 1):
        classes = top + int(_STARTS[other + 1]) - 1 + 2
        if classes < 1:
            continue
        owner = (textscan.mix(tokens + np.uint64(classes)) % np.uint64(classes)).astype(np.int64)
        sums = sum(np.bincount(owner, part, classes).astype(np.uint64) << shift for part, shift in parts)
        key = textscan.mix(np.array([min(own, other) << 16 | max(own, other)], np.uint64) ^ _SALT_B)
        found.append(textscan.mix(sums + textscan.mix(np.arange(classes, dtype=np.uint64) + key)))
    return found


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """What a set is indexed by. ``tokens`` ascend; ``frequent`` flags them. Sets of at most 3 link to no other set at 80 %."""
    n = len(tokens)
    if n == 0 or 100 * n < percent * (n + 1):
        return np.zeros(0, np.uint64)
    rare, p = tokens[~frequent], prefix_length(n, percent)
    if len(rare) >= p:
        return rare[:p]
    return np.unique(np.concatenate([rare, *combinations(tokens[frequent], n, percent)]))


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bit b is the parity of the number of tokens with hash b; two sets differ in at least as many tokens as bits."""
    bits = np.bincount((tokens & np.uint64(64 * BITMAP_LONGS - 1)).astype(np.int64), minlength=64 * BITMAP_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _digest(tokens: np.ndarray, salt: np.uint64) -> int:
    return int(textscan.mix(tokens ^ salt).sum(dtype=np.uint64).astype(np.int64)) if len(tokens) else 0


_FACTS = [T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
          T.StructField("bits", _LONGS), T.StructField("sigs", _LONGS)]


def _facts(sets: list[np.ndarray], flags: list[np.ndarray], percent: int) -> dict[str, list]:
    return {"n": [len(s) for s in sets], "d1": [_digest(s, _SALT_A) for s in sets], "d2": [_digest(s, _SALT_B) for s in sets],
            "bits": [parity_bitmap(s) for s in sets], "sigs": [signatures(s, f, percent).view(np.int64) for s, f in zip(sets, flags)]}


def _sets(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, tokens ascending) per row."""
    def work(texts: list[bytes]) -> dict[str, list]:
        return {"tokens": [s.view(np.int64) for s in textscan.Scan(texts, lower=True).shingle_sets()]}

    return (common.map_texts(docs, text, [id_column], work, [T.StructField("tokens", _LONGS)])
            .select(F.col(f"row.`{id_column}`").alias("doc_id"), F.col("out.tokens").alias("tokens")))


def frequent_tokens(docs: DataFrame, text: str, above: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(token) of more than ``above`` rows.

    Tasks count what they hold and deal the distinct tokens with their counts by their leading bits, packed, into buckets whose number
    follows the bytes of all texts; a token is once in a task's parcel, so no bucket grows with the number of its documents.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets = 1 << max(4, (size // bucket_bytes).bit_length(), (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def parcels(batches):
        held, waiting = [], 0
        for batch in batches:
            for _, texts in textscan.chunked(batch.column(0)):
                held += textscan.Scan(texts, lower=True).shingle_sets()
                waiting += sum(map(len, held[-len(texts):]))
                if waiting >= PARCEL_TOKENS:
                    yield parcel(held)
                    held, waiting = [], 0
        if held:
            yield parcel(held)

    def parcel(sets: list[np.ndarray]):
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        bucket = (tokens >> shift).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        last = np.append(first[1:], len(tokens))
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[first], pa.int64()), pa.array([tokens[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
            pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in zip(first, last)], pa.binary())], names=["bucket", "tokens", "counts"])

    def count(rows: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(rows["tokens"].to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint32)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        many = np.add.reduceat(counts[order], first, dtype=np.int64) > above
        return pa.table({"token": tokens[first[many]].view(np.int64)})

    dealt = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(parcels, "bucket long, tokens binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(count, "token long")


def set_facts(docs: DataFrame, id_column: str, text: str, percent: int, frequent_above: int, broadcast_tokens: int) -> DataFrame:
    """(doc_id, n, d1, d2, bits, sigs) per row."""
    spark = docs.sparkSession
    frequent = common.stage(frequent_tokens(docs, text, frequent_above), "frequent")
    if frequent.count() <= broadcast_tokens:
        held = spark.sparkContext.broadcast(np.sort(frequent.toPandas()["token"].to_numpy(np.int64).view(np.uint64)))

        def work(texts: list[bytes]) -> dict[str, list]:
            sets, known = textscan.Scan(texts, lower=True).shingle_sets(), held.value
            if not len(known):
                return _facts(sets, [np.zeros(len(s), bool) for s in sets], percent)
            whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            hit = known[np.minimum(np.searchsorted(known, whole), len(known) - 1)] == whole
            return _facts(sets, np.split(hit, np.cumsum([len(s) for s in sets])[:-1]), percent)

        rows = common.map_texts(docs, text, [id_column], work, _FACTS)
        return rows.select(F.col(f"row.`{id_column}`").alias("doc_id"), "out.*")
    # too many frequent tokens to hold in a task: mark them by a join and gather each set again
    sets = _sets(docs, id_column, text).withColumn("place", F.monotonically_increasing_id())
    sets = common.stage(sets, "sets")
    marks = (sets.select("place", F.explode("tokens").alias("token")).join(frequent, "token")
             .groupBy("place").agg(F.collect_list("token").alias("hot")))
    marked = sets.join(marks, "place", "left").select("doc_id", "tokens", "hot")
    id_type = marked.schema["doc_id"]
    schema = T.StructType([id_type, *_FACTS])

    def flag(batches):
        for batch in batches:
            tokens = [np.array(t, np.int64).view(np.uint64) for t in batch.column("tokens").to_pylist()]
            hot = [np.array(t or [], np.int64).view(np.uint64) for t in batch.column("hot").to_pylist()]
            facts = _facts(tokens, [np.isin(t, h) for t, h in zip(tokens, hot)], percent)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(facts[f.name], common.arrow_type(f.dataType)) for f in _FACTS]],
                names=["doc_id", *[f.name for f in _FACTS]])

    return marked.mapInArrow(flag, schema)


def _size_fits(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def may_link(n_a: Column, bits_a: Column, n_b: Column, bits_b: Column, percent: int) -> Column:
    """False only for sets that do not link: overlap <= (n_a + n_b - differing parities) / 2, and a link needs
    overlap * (100 + percent) >= percent * (n_a + n_b)."""
    differ = sum(F.bit_count(F.get(bits_a, F.lit(i)).bitwiseXOR(F.get(bits_b, F.lit(i)))) for i in range(BITMAP_LONGS))
    return _size_fits(n_a, n_b, percent) & ((n_a + n_b - differ) * (100 + percent) >= 2 * percent * (n_a + n_b))


def verified(pairs: DataFrame, facts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. ``facts``: (rep, n, bits); ``sets_of`` ids (rep): (rep, tokens)."""
    def side(name: str) -> DataFrame:
        return facts.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))

    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(
        may_link(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"), percent))
    # few pairs pass the bound: only their sets are made, from a list of ids of a counted size or else by a merge join
    near = common.stage(near.select("a", "b"), "near")
    ids = near.select(F.col("a").alias("rep")).union(near.select("b")).distinct()
    sets = common.stage(sets_of(F.broadcast(ids) if near.count() <= BROADCAST_PAIRS else ids.hint("merge")), "sets")
    both = (near.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tokens_b")), "b"))
    both = both.select("a", "b", (F.size("tokens_a") + F.size("tokens_b")).alias("total"),
                       F.size(F.array_intersect("tokens_a", "tokens_b")).alias("shared"))
    links = common.stage(both.where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).select("a", "b").distinct(), "links")
    common.discard(sets, near)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable by the links (a, b). Labels jump to their label's label in each round."""
    edges = common.stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = common.stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        stepped = (labels.join(near, "node").join(jump, "comp", "left")
                   .select("node", F.least("comp", "near", F.coalesce("far", "comp")).alias("comp"), F.col("comp").alias("old")))
        stepped = common.stage(stepped, "labels")
        done = stepped.where("comp < old").isEmpty()
        common.discard(labels)
        labels = stepped.select("node", "comp")
        if done:
            common.discard(edges)
            return labels


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, comp) after more links between the components ``comps`` (rep, comp); only what the links touch is walked again."""
    def of(side: str) -> DataFrame:
        return comps.select(F.col("rep").alias(side), F.col("comp").alias(f"comp_{side}"))

    between = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
               .select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a <> b"))
    joined = common.stage(components(between), "merged")
    old = comps.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("into")), "comp", "left").select("rep", F.coalesce("into", "comp").alias("comp"))
    new = joined.join(comps.select(F.col("rep").alias("node")), "node", "left_anti").select(F.col("node").alias("rep"), "comp")
    return common.stage(old.union(new), "comps")


def join_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, frequent_above: int = FREQUENT,
                   rounds: int = ROUNDS, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    with common.tidy_shuffles(docs.sparkSession):
        return _joined(docs, id_column, text, percent, frequent_above, rounds, broadcast_tokens)


def _joined(docs: DataFrame, id_column: str, text: str, percent: int, frequent_above: int, rounds: int, broadcast_tokens: int) -> DataFrame:
    facts = common.stage(set_facts(docs, id_column, text, percent, frequent_above, broadcast_tokens), "facts")
    classes = common.stage(facts.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    # by id and digest: all rows of a large class share the digest, but one alone has the id
    reps = facts.withColumn("rep", F.col("doc_id")).join(classes, ["rep", "n", "d1", "d2"]).drop("doc_id")
    # dealt once by signature; what follows in this step keeps that
    indexed = reps.select("rep", "n", F.explode("sigs").alias("sig")).repartition("sig")
    # signatures of the same members say the same: one of them stays, told by the number and two sums of hashes of the members
    leaders = indexed.groupBy("sig").agg(F.count("*").alias("held"), F.min(F.struct("rep", "n")).alias("lead"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x1"),
                                         F.bit_xor(F.xxhash64("rep", F.lit(2))).alias("x2")).where("held > 1")
    leaders = leaders.groupBy("held", "lead", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig", "lead")
    live = common.stage(indexed.join(leaders, "sig").select("sig", "rep", "n", "lead"), "live")
    wanted = live.select("rep").distinct()
    rep_facts = common.stage(reps.select("rep", "n", "bits").join(wanted, "rep"), "repfacts")

    def sets_of(ids: DataFrame) -> DataFrame:
        chosen = docs.join(ids.withColumnRenamed("rep", id_column), id_column, "left_semi")
        return _sets(chosen, id_column, text).withColumnRenamed("doc_id", "rep")

    pairs = (live.where(F.col("rep") != F.col("lead.rep")).where(_size_fits(F.col("n"), F.col("lead.n"), percent))
             .select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")))
    comps = components(verified(pairs, rep_facts, sets_of, percent)).withColumnRenamed("node", "rep")
    for number in range(1, rounds + 1):
        placed = live.select("sig", "rep", "n").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        per_comp = placed.groupBy("sig", "comp").agg(F.count("*").alias("held"))
        main = (per_comp.groupBy("sig").agg(F.max(F.struct("held", "comp")).alias("top"), F.count("*").alias("comps"))
                .where("comps > 1").select("sig", F.col("top.comp").alias("main")))
        mixed = placed.join(main, "sig").join(rep_facts.select("rep", "bits"), "rep")
        rest = mixed.where(F.col("comp") != F.col("main"))
        if number < rounds:     # what is outside the largest component looks at the largest of the others
            second = (rest.groupBy("sig", "comp").agg(F.count("*").alias("held"), F.min(F.struct("rep", "n", "bits")).alias("lead"))
                      .groupBy("sig").agg(F.max(F.struct("held", "comp", "lead")).alias("second")))
            lead = F.col("second.lead")
            pairs = (rest.join(second, "sig").where((F.col("comp") != F.col("second.comp")) & may_link(F.col("n"), F.col("bits"), lead["n"], lead["bits"], percent))
                     .select(F.least("rep", lead["rep"]).alias("a"), F.greatest("rep", lead["rep"]).alias("b")))
        else:                   # and then at all members of other components
            other = mixed.select("sig", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"), F.col("bits").alias("bits2"))
            apart = (F.col("comp") != F.col("comp2")) & ((F.col("comp2") == F.col("main")) | (F.col("rep") < F.col("rep2")))
            same_sig = rest["sig"] == other["sig"]
            pairs = (rest.join(other, same_sig & apart & may_link(F.col("n"), F.col("bits"), F.col("n2"), F.col("bits2"), percent))
                     .select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")))
        comps = merged(comps, verified(pairs, rep_facts, sets_of, percent))
    common.discard(live, rep_facts)
    named = classes.join(comps, "rep", "left").select("n", "d1", "d2", F.coalesce("comp", "rep").alias("class_component"))
    return (facts.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component; rows without an id stay."""
    joined = join_documents(docs, id_column, text, **options)
    copies = joined.where("component_id <> doc_id").select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(copies.hint("merge"), id_column, "left_anti").select(*docs.columns)


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM shingles WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
rows AS (SELECT rep, n, unnest(s) AS token FROM classes),
held AS (SELECT token FROM rows GROUP BY token HAVING count(*) > 1),
live AS (SELECT rep, n, token FROM rows SEMI JOIN held USING (token)),
links AS (
  SELECT x.rep AS a, y.rep AS b FROM live x JOIN live y ON x.token = y.token AND x.rep < y.rep
  WHERE 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
comps AS (SELECT node AS rep, least(node, min(seen)) AS comp FROM reach GROUP BY node)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(m.comp, c.rep, d.doc_id) AS component_id
FROM shingles d LEFT JOIN classes c ON list_sort(d.s) = c.s LEFT JOIN comps m ON m.rep = c.rep
"""
