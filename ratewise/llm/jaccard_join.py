"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets with overlap o of at least T tokens share their first l common tokens
(in any one order of all tokens) within prefixes of length n - T + l.  Each
document chooses its own l: a longer prefix means more list entries, but a
partner must then share l tokens, not one.  The choice takes the smallest
estimated cost, list entries read plus candidates verified, from the exact
list lengths of its own prefix tokens.  A pair is a candidate when it shares
min(l_x, l_y) prefix tokens; no qualifying pair can be missed.

The token order puts tokens that are common in some block of the input last
(a Bloom filter of bounded size tells which), so lines and passages that many
documents share do not fill the prefixes.  The order only steers the cost.

Links are only needed between texts that are not connected yet:
 1. documents with the same set form a class and go on as one;
 2. a star round verifies every document against one leader of its lists, so
    a group of near copies takes as many pairs as members;
 3. inside a leader's group the rest is found in the differences from the
    leader.  With R(x) the tokens in which x and the leader differ, x and y
    differ in R(x) + R(y) - 2 |R(x) & R(y)| tokens; so if x and y are similar
    and not both are similar to the leader, they share a known part of these
    short sets, and a prefix join with positions on them finds all such pairs;
 4. across groups, the lists are joined exactly.  In each list the rows of its
    most frequent group meet only the others, never each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_of, components, forest_roots, is_empty, scratch
from .textbatch import batch_shingles, in_chunks

MAX_MATCH = 4
#: Cost of verifying a candidate, in list entries.
VERIFY_COST = 16
#: Documents of one block of text that share a token, and in sum over blocks, for it to go to the end of the order.
COMMON_IN_BLOCK, COMMON = 3, 24
#: A pair's two sets weigh as much as so many rows.
SET_ROWS = 50
#: Tokens of a block, 8 bytes each.
BLOCK_TOKENS = 4_000_000


def least_overlap(n, percent: int):
    return -(-n * percent // 100)


def common_tokens(docs: DataFrame, k: int) -> DataFrame:
    """Tokens that several documents of a block of text share, with the sum
    of their counts over those blocks."""

    def counted(sets):
        token, count = np.unique(np.concatenate(sets), return_counts=True)
        many = count >= COMMON_IN_BLOCK
        return pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(count[many].astype(np.int64))],
                                          names=["token", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in in_chunks(batch, 1):
                sets = batch_shingles(part.column(1), k)
                held += sets
                size += sum(map(len, sets))
                if size >= BLOCK_TOKENS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)


def signatures(docs: DataFrame, k: int, percent: int, common) -> DataFrame:
    """``doc_id, n, key, prefix``: set size, 128-bit digest of the set and the
    longest prefix that any choice of l takes, in token order."""

    def run(batches):
        for batch in batches:
            for part in in_chunks(batch, 1):
                sets = batch_shingles(part.column(1), k)
                n = np.array([len(s) for s in sets], np.int64)
                every = np.concatenate(sets)
                last = common.value.has(every) if len(every) else np.zeros(0, bool)
                prefix, keys, at = [], [], 0
                for s in sets:
                    tail = last[at:at + len(s)]
                    at += len(s)
                    least = least_overlap(len(s), percent)
                    p = len(s) - least + min(MAX_MATCH, least)
                    prefix.append(np.concatenate([s[~tail], s[tail]])[:p] if tail.any() else s[:p])
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                off = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(prefix).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(keys, pa.binary()), lists],
                                                 names=["doc_id", "n", "key", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, prefix array<long>")


def compare(pairs: DataFrame, docs: DataFrame, k: int, percent: int, reps: DataFrame | None = None,
            carry: list[str] = []) -> DataFrame:
    """``a, b, na, nb, linked, residual`` of the rows ``(a, b)`` of ``pairs``:
    set sizes, whether the sets reach the similarity, and the tokens in which
    they differ (null when they have less than half of their tokens in
    common); ``carry`` names long columns to pass on.  The texts are read
    again for the sets of the documents in ``pairs`` alone.  ``a`` and
    ``b`` are ``doc_id``s or, with ``reps(node, doc_id, key)``, the nodes of
    single sets."""
    n_pairs = pairs.count()
    nodes = scratch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes", 2 * n_pairs)
    ids = (nodes.select(F.col("node").alias("doc_id"), "node") if reps is None
           else scratch(reps.join(nodes, "node"), "reps", 2 * n_pairs))
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_of(ids, "doc_id", nodes.count()))     # 2^28 bits at most

    def sets_of(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            found = batch.filter(pa.array(wanted.value.has(ids.view(np.uint64))))
            for part in in_chunks(found, 1) if found.num_rows else ():
                tokens = [s.tobytes() for s in batch_shingles(part.column(1), k)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([xxhash.xxh3_128_digest(t) for t in tokens], pa.binary()), pa.array(tokens, pa.binary())],
                    names=["doc_id", "key", "tokens"])

    def run(batches):
        for batch in batches:
            na, nb, ok, residual = [], [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                apart = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(apart)) // 2
                na.append(len(x))
                nb.append(len(y))
                ok.append(100 * both >= percent * (both + len(apart)))
                residual.append(apart.view(np.int64) if 2 * both >= both + len(apart) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(ok, pa.bool_()),
                 pa.array(residual, pa.list_(pa.int64())), *batch.columns[4:]],
                names=["a", "b", "na", "nb", "linked", "residual", *carry])

    sets = scratch(docs.where("doc_id is not null").mapInArrow(sets_of, "doc_id long, key binary, tokens binary"), "sets")
    sets = sets.withColumnRenamed("doc_id", "node") if reps is None else sets.join(ids, ["doc_id", "key"])
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return scratch(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", *carry)
                   .mapInArrow(run, ", ".join(["a long, b long, na long, nb long, linked boolean, residual array<long>",
                                               *[f"{c} long" for c in carry]]))
                   .dropDuplicates(["a", "b"]), "compared", SET_ROWS * n_pairs)      # a node may have several rows of one set


def residual_pairs(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidates ``(a, b)`` of one leader's group that are in different
    components.  ``a`` is not similar to the leader.  ``b`` then shares more
    than (R(b) + c (leader's size - b's size)) / 2 residual tokens with ``a``,
    c = (100 - percent) / (100 + percent), which bounds the prefix of ``b``;
    rare tokens of the group come first."""
    c = (100 - percent) / (100 + percent)
    rows = (stars.where("residual is not null")
            .select(F.col("a").alias("lead"), F.col("na").alias("n_lead"), F.col("b").alias("node"), F.col("nb").alias("n"), "linked",
                    F.size("residual").alias("r"), F.explode("residual").alias("token"))
            .join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    # groups of one component, and groups without a member apart from the leader, are done
    open_groups = scratch(stars.where("residual is not null and not linked").select(F.col("a").alias("lead")).distinct(), "open-groups", stars.count())
    rows = scratch(rows.join(open_groups, "lead", "left_semi"), "residuals")
    n_rows = rows.count()
    seen = scratch(rows.groupBy("lead", "token").agg(F.count("*").alias("df")).where("df > 1"), "seen", n_rows)
    # tokens of one member alone come first in the order and match nothing
    common = rows.join(seen, ["lead", "token"])
    by = Window.partitionBy("node").orderBy(F.desc("df"), F.desc("token"))
    placed = scratch(common.withColumn("i", F.col("r") - F.row_number().over(by) + 1), "placed", n_rows)
    prefix = F.col("i") <= F.col("r") - F.greatest(F.lit(0), F.floor((F.col("r") + c * (F.col("n_lead") - F.col("n"))) / 2 - 1e-9))
    x = placed.where("not linked").select("lead", "token", *[F.col(v).alias(f"{v}_a") for v in ("node", "n", "r", "comp", "i")])
    y = placed.where(prefix).select("lead", "token", *[F.col(v).alias(f"{v}_b") for v in ("node", "n", "r", "comp", "i")])
    need = (F.col("r_a") + F.col("r_b") - c * (F.col("n_a") + F.col("n_b"))) / 2 - 1e-9
    return (x.join(y, ["lead", "token"])
            .where((F.col("comp_a") != F.col("comp_b")) & (1 + F.least(F.col("r_a") - F.col("i_a"), F.col("r_b") - F.col("i_b")) >= need)
                   & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent))
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "comp_a", "comp_b"))


def several_sets(sigs: DataFrame) -> DataFrame:
    """The ``doc_id`` of the documents whose rows have unequal sets."""
    return scratch(sigs.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high"))
                   .where("low <> high").select("doc_id"), "several")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Sets of distinct ``k``-word shingles (A-Z lower-cased; fewer words: the
    whole sequence as one shingle); documents link when 100 * intersection >=
    ``percent`` * union; the component is named by its smallest ``doc_id``.
    Null and empty texts, and texts without words, have empty sets and link
    with nothing.  Rows with one ``doc_id`` are one component, whatever
    their texts.  Rows
    without a ``doc_id`` link with nothing and have a null component.  An empty
    table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = scratch(common_tokens(src, k), "common")
    last = spark.sparkContext.broadcast(bloom_of(common, "token", common.count()))       # 2^28 bits at most
    sigs = scratch(signatures(src, k, percent, last), "signatures")
    real = sigs.where("n > 0 and doc_id is not null")
    # equal sets have equal prefixes, so any one of a class will do
    classes = scratch(real.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix")),
                      "classes")
    several = several_sets(sigs)
    if is_empty(several):
        classes, reps = classes.withColumn("node", F.col("doc_id")), None
    else:                   # a doc_id would name several sets
        classes = scratch(classes.withColumn("node", F.monotonically_increasing_id()), "numbered")
        reps = classes.select("node", "doc_id", "key")

    # list entries; tokens of one class alone are dropped
    entries = classes.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    shared = scratch(entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    least = F.ceil(F.col("n") * percent / 100)
    mine = Window.partitionBy("node")
    cost = [F.sum(F.when(F.col("at") < F.col("n") - least + m, F.col("df") - 1).otherwise(0)).over(mine) * (1 + VERIFY_COST / m)
            for m in range(1, MAX_MATCH + 1)]
    lists = scratch(entries.join(shared, "token").withColumns({f"c{m}": c for m, c in enumerate(cost, 1)})
                    .withColumn("best", F.least(*[f"c{m}" for m in range(1, MAX_MATCH + 1)]))
                    .withColumn("matches", F.least(F.greatest(F.lit(1), least), F.coalesce(
                        *[F.when(F.col(f"c{m}") <= F.col("best"), F.lit(m)) for m in range(1, MAX_MATCH + 1)])).cast("long"))
                    .where(F.col("at") < F.col("n") - least + F.col("matches"))
                    .select("token", "node", "n", F.col("at").cast("long").alias("at"), "matches"), "lists")
    similar_size = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    n_lists = lists.count()
    # one leader for each document
    lead = scratch(lists.groupBy("token").agg(F.min(F.struct("node", "n", "matches")).alias("lead")), "lead", n_lists)
    best = (lists.join(lead, "token")
            .select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("lead.node").alias("a"), F.col("lead.n").alias("na"),
                    F.least("matches", "lead.matches").alias("need"))
            .where("a <> b").where(similar_size)
            .groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need")).where("c >= need")
            .groupBy("b").agg(F.max(F.struct("c", F.negative("a").alias("a"))).alias("m"))
            .select(F.negative("m.a").alias("a"), "b"))
    stars = compare(scratch(best, "best", n_lists), src, k, percent, reps)
    # a leader is the smallest node of a list, so these links are a forest
    labels = scratch(forest_roots(stars.where("linked").select(F.col("b").alias("node"), F.col("a").alias("parent")), "star", n_lists), "labels", n_lists)

    # across groups
    groups = stars.where("residual is not null").select(F.col("b").alias("node"), F.col("a").alias("group"))
    rows = scratch(lists.join(groups, "node", "left").join(labels, "node", "left")
                   .select("token", "node", "n", "at", "matches", F.coalesce("group", "node").alias("group"),
                           F.coalesce("comp", "node").alias("comp")), "rest", n_lists)
    mixed = scratch(rows.groupBy("token", "group").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                    .groupBy("token").agg(F.max(F.struct("c", "group")).getField("group").alias("main"), F.count("*").alias("n_groups"),
                                          F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                    .where("n_groups > 1 and lo <> hi").select("token", "main"), "mixed", n_lists)
    rows = scratch(rows.join(mixed, "token"), "open", n_lists)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("n", "at", "matches", "group", "comp")]
    one = rows.where("group <> main").select("token", F.col("node").alias("a"), *side("a"))
    two = rows.select("token", F.col("node").alias("b"), *side("b"), "main")
    # the first common tokens stand early enough for the overlap that the pair needs; later ones add nothing to the count
    early = (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("matches_a", "matches_b") - 1
             >= F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent) - 1e-9))
    across = (one.join(two, "token")
              .where((F.col("group_a") != F.col("group_b")) & (F.col("comp_a") != F.col("comp_b"))
                     & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
                     & (F.col("a") != F.col("group_b")) & (F.col("b") != F.col("group_a"))
                     & ((F.col("group_b") == F.col("main")) | (F.col("a") < F.col("b"))) & early)
              .groupBy("a", "b", "comp_a", "comp_b").agg(F.count("*").alias("c"), F.min(F.least("matches_a", "matches_b")).alias("need"))
              .where("c >= need").select("a", "b", "comp_a", "comp_b"))
    pairs = scratch(across.unionByName(residual_pairs(stars, labels, percent)).distinct(), "pairs")
    links = compare(pairs, src, k, percent, reps, ["comp_a", "comp_b"]).where("linked")
    links = links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    named = classes.select("key", "doc_id", "node")
    named = named.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    if reps is not None:    # the sets of one doc_id go together
        same = scratch(real.join(several, "doc_id", "left_semi").select("doc_id", "key").distinct()
                       .join(named.select("key", "comp"), "key"), "same")
        links = links.unionByName(same.join(scratch(same.groupBy("doc_id").agg(F.min("comp").alias("b")), "same-least"), "doc_id")
                                  .select(F.col("comp").alias("a"), "b"))
    joined = components(links, "last", links.count())
    named = (named.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("last")), "comp", "left")
             .select("key", "doc_id", F.coalesce("last", "comp").alias("comp")))
    # nodes that are no ids: the component's smallest doc_id names it; a row without words goes with its doc_id's others
    of_id = None
    if reps is not None:
        named = scratch(named, "named")
        names = scratch(named.groupBy("comp").agg(F.min("doc_id").alias("name")), "names")
        named = scratch(named.join(names, "comp").select("key", F.col("name").alias("comp")), "renamed")
        of_id = scratch(same.select("doc_id", "key").join(named, "key").groupBy("doc_id").agg(F.min("comp").alias("of_id")), "of-id")
    out = sigs.join(named.select("key", "comp"), "key", "left")
    out = out.withColumn("of_id", F.lit(None).cast("long")) if of_id is None else out.join(of_id, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("comp"))
                      .otherwise(F.coalesce("of_id", "doc_id")).alias("component_id"))
