"""Near-duplicates by one-permutation MinHash.

One hash of each word pair gives a set; its range is divided into bins and each bin
keeps its least value (one permutation).  Empty bins borrow from filled ones by the
tries of a fixed hash of (bin, try), the same for every document, which is optimal
densification.  Runs of bins make band keys; documents that share a key meet in a
bucket.  Within a bucket every member is tied to one hub, so a bucket of m documents
gives m - 1 candidate pairs.  Candidates are confirmed on the full sets.

Equal sets are merged before anything is paired.  Candidates come in three rounds.
Each document meets the best of its hubs.  Documents whose hubs are in one component
are a family, and families that hold mostly the same documents are one; where a family
has several components, each member meets its middle, the one nearest to the shingles
that most have.  Members that the middle does not tie are then joined with others by
what sets have beyond those shingles, or lack of them: by one such feature, and where
that would give more than ``PAIRS_A_MEMBER`` pairs a member, by several at once.  So no
link between documents that share a bucket is lost, and a group of copies is not
expanded into its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .memory import settle
from .tables import Scratch, bound_batches, drop_rows, stash, table
from .words import mix, windows, word_hashes

SHINGLE_WORDS = 2
PERCENT = 80
BANDS, ROWS = 32, 4
#: Pairs a member above which a family is joined by more features at once, and keys that a member may have for it at the mean.
PAIRS_A_MEMBER, KEYS_A_MEMBER = 16, 1000
LEVELS = (1, 2, 4, 6)
#: Members of a family that one part of a join takes, and the most parts of a family.
MEMBERS_A_SALT, MOST_SALTS = 1024, 256
_U = np.uint64


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a whole text's word runs; a text with fewer words is one run."""
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if 0 < len(hashes) < words:
        return windows(hashes, len(hashes)) ^ _U(len(hashes))
    return np.unique(windows(hashes, words))


def _donors(bins: int, tries: int = 4096) -> np.ndarray:
    """[try, bin]: the bin that an empty bin asks at each try."""
    grid = np.arange(tries, dtype=_U)[:, None] * _U(bins) + np.arange(bins, dtype=_U)[None, :]
    return (mix(mix(grid + _U(0x5851F42D4C957F2D))) % _U(bins)).astype(np.int64)


def signature(sets: np.ndarray, bins: int, donors: np.ndarray) -> np.ndarray:
    """The least hash of each bin, densified; ``sets`` must be sorted and not empty, ``bins`` a power of two."""
    shift = _U(64 - bins.bit_length() + 1)
    of = (sets >> shift).astype(np.int64)
    first = np.searchsorted(of, np.arange(bins))
    filled = np.zeros(bins, bool)
    filled[of] = True
    out = sets[np.minimum(first, len(sets) - 1)]
    if filled.all():
        return out
    empty = np.flatnonzero(~filled)
    for asked in donors:
        got = filled[asked[empty]]
        out[empty[got]] = out[asked[empty[got]]]
        empty = empty[~got]
        if not len(empty):
            break
    out[empty] = sets[0]  # after thousands of tries without a filled bin
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for column in sig[: bands * rows].reshape(bands, rows).T:
        keys = mix(keys * _U(0xD1342543DE82EF95) + column)
    return keys


def _digest(sets: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(sets.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(docs: DataFrame, words: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, keys): size and digest of each set, and its band keys.

    A set of n can only reach the threshold with a different one if n / (n + 1) does;
    smaller sets get no keys.
    """
    bins = 1 << (bands * rows - 1).bit_length()
    least = percent / (100 - percent) if percent < 100 else float("inf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        donors = _donors(bins)
        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for text in batch.column(1):
                sets = shingles(text.as_py(), words)
                n.append(len(sets))
                x, y = _digest(sets)
                d1.append(x)
                d2.append(y)
                keys.append(band_keys(signature(sets, bins, donors), bands, rows).view(np.int64) if len(sets) >= least else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), flat], ["doc_id", "n_shingles", "d1", "d2", "keys"])
        settle()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], ["id", "s"])
        settle()

    return docs.select("doc_id", "text").mapInArrow(run, "id long, s binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for the pairs, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    linked.append(False)
                    continue
                at = np.searchsorted(p, q)
                at[at == len(p)] = 0
                both = int((p[at] == q).sum())
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])
        settle()

    with_a = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a")
    with_both = with_a.join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    return with_both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, linked boolean")


def _merged(members: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """Members (family, rep, c) with families that have more than half of their members in a larger one, as those see it, united with it.

    A document ties its families to the largest of them, so a document in m families gives m - 1 ties.
    """
    sizes = scratch.stash(members.groupBy("family").agg(F.count(F.lit(1)).alias("size")), "family-sizes", rows)
    sized = members.join(sizes, "family")
    main = sized.groupBy("rep").agg(F.max(F.struct("size", "family")).alias("main")).select("rep", F.col("main.family").alias("main"))
    shared = sized.join(main, "rep").filter("family != main").groupBy("family", "main", "size").agg(F.count(F.lit(1)).alias("shared"))
    ties = scratch.stash(shared.filter("2 * shared > size").select(F.col("family").alias("a"), F.col("main").alias("b")), "family-ties", rows)
    if ties.isEmpty():
        return members
    united = scratch.stash(components(ties), "united-families", rows).withColumnsRenamed({"node": "family", "component": "united"})
    return scratch.stash(members.join(united, "family", "left").select(F.coalesce("united", "family").alias("family"), "rep", "c").distinct(), "united-members")


def _cores(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, core, salts): the shingles that more than half of a family has, judged by 64 of its members at most, and into how many parts its members are dealt."""
    part = F.pmod(F.xxhash64("rep"), F.lit(64))
    some = members.groupBy("family", part.alias("part")).agg(F.min("rep").alias("id"), F.count(F.lit(1)).alias("n")).join(sets, "id")

    def vote(rows: pa.Table) -> pa.Table:
        found = [np.frombuffer(x.as_buffer(), _U) for x in rows.column("s").combine_chunks()]
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        core = values[2 * counts > len(found)]
        salts = min(MOST_SALTS, 1 + sum(rows.column("n").to_pylist()) // MEMBERS_A_SALT)
        return pa.table({"family": pa.array([rows.column("family")[0].as_py()], pa.int64()), "core": pa.array([core.tobytes()], pa.binary()), "salts": pa.array([salts], pa.int32())})

    return some.select("family", "s", "n").groupBy("family").applyInArrow(vote, "family long, core binary, salts int")


def _salted(families: DataFrame) -> DataFrame:
    """A row of a family for each part that its members are dealt into: joined by (family, salt), no family lands in one task."""
    return families.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _against_core(members: DataFrame, cores: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (family, rep, c, salt of salts) with sizes n of their set and nc of the core, the number m of shingles missing of it, and those and the ones beyond it as ``d``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, nc, differ = [], [], [], []
            for x, y in zip(batch.column(5), batch.column(6), strict=True):
                core, own = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                missing = np.setdiff1d(core, own, assume_unique=True)
                n.append(len(own))
                m.append(len(missing))
                nc.append(len(core))
                differ.append(np.concatenate([missing, np.setdiff1d(own, core, assume_unique=True)]))
            d = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, differ)]).astype(np.int32)), pa.array(np.concatenate([*differ, np.empty(0, _U)]).view(np.int64)))
            sizes = [pa.array(v, pa.int64()) for v in (n, m, nc)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *sizes, d], ["family", "rep", "c", "salt", "salts", "n", "m", "nc", "d"])
        settle()

    dealt = members.join(cores.select("family", "salts"), "family").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    both = dealt.join(sets.withColumnRenamed("id", "rep"), "rep").join(_salted(cores), ["family", "salt"])
    return both.select("family", "rep", "c", "salt", "salts", "core", "s").mapInArrow(run, "family long, rep long, c long, salt int, salts int, n long, m long, nc long, d array<long>")


def _linked(percent: int) -> Column:
    """Whether two members of a family are linked: a set has the core but for m of it, and two share what both lack of it or have beyond it."""
    both = F.col("nc") - F.col("m_a") - F.col("m_b") + F.size(F.array_intersect("d_a", "d_b"))
    return 100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)


def _confirm_beyond(pairs: DataFrame, against: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for the pairs (family, a, b), without moving what their cores hold."""
    side = lambda k: against.select("family", F.col("rep").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "m", "d")), *(["nc"] if k == "a" else []))
    return pairs.join(side("a"), ["family", "a"]).join(side("b"), ["family", "b"]).select("a", "b", _linked(percent).alias("linked"))


def _features(against: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(family, rep, c, salt, salts, strange, nc, g, features): the features that a stranger and another member have, rarest first.

    Two members share  nc - m_a - m_b  shingles and those in both of their ``d``.  A link
    asks for  p / (1 + p) * (n_a + n_b)  at least, so with  g = p * n + (1 + p) * m  they
    must share  (g_a + g_b) / (1 + p) - nc  features.  Where that is not above 0, both are
    linked to the middle, whose g is least, and so to each other.
    """
    feature = against.select("family", "rep", "strange", F.explode("d").alias("shingle"))
    often = feature.groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("often"), F.bool_or("strange").alias("used")).filter("often > 1 AND used").drop("used")
    mine = feature.join(often, ["family", "shingle"]).groupBy("family", "rep").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("features"))
    g = F.expr(f"{percent} * n + {100 + percent} * m")
    member = against.select("family", "rep", "c", "salt", "salts", "strange", "nc", g.alias("g")).join(mine, ["family", "rep"])
    return scratch.stash(member.withColumn("features", F.transform("features", lambda x: x["shingle"])), "family-features")


def _lists(members: DataFrame, percent: int, k: int) -> DataFrame:
    """How members look for each other by ``k`` features at once, or as many as a pair must share: a member as the lower or the upper of a pair by (g, rep).

    The lower knows that its partner asks for no less than it does itself.  An upper looks
    among the lowers of one kind (at home or not, number of features) and knows the least
    g of those.  A member at home looks for strangers only.  ``need`` of the features are
    shared at least; who has fewer has no link.
    """
    whole = 100 + percent
    need = lambda x, y: F.expr(f"greatest(1, int(ceil(({x} + {y} - {whole} * nc) / {whole})))")
    strangers = members.filter("strange").groupBy("family").agg(F.min("g").alias("gs"), F.max("salts").alias("salts"))
    low = members.join(_salted(strangers), ["family", "salt"]).withColumn("need", need("g", "if(strange, g, greatest(g, gs))")).filter(F.size("features") >= F.col("need"))
    low = low.withColumn("taken", F.least("need", F.lit(k))).withColumn("kind", F.struct("strange", "taken"))
    kinds = low.groupBy("family", "kind").agg(F.min("g").alias("gl"), F.max("salts").alias("salts"))
    up = members.join(_salted(kinds), ["family", "salt"]).filter("g >= gl AND (strange OR kind.strange)").withColumn("need", need("g", "gl")).withColumn("taken", F.col("kind.taken"))
    columns = ["family", "kind", "rep", "c", "g", "taken", "need", "features"]
    both = low.select(F.lit(True).alias("lower"), *columns).unionByName(up.filter(F.size("features") >= F.col("need")).select(F.lit(False).alias("lower"), *columns))
    return both.withColumn("features", F.expr("slice(features, 1, size(features) - need + taken)")).drop("need")


def _keys(lists: DataFrame, k: int) -> DataFrame:
    """A key for each choice of ``taken`` features of a list: the first that a pair shares stand, in either list, before what its need leaves for others."""
    columns = ["family", "kind", "lower", "rep", "c", "g"]
    left, out = lists.select(*columns, "taken", F.col("features").alias("rest"), F.lit(0).cast("long").alias("key")), None
    for step in range(1, k + 1):
        found = left.select(*columns, "taken", F.col("key").alias("so_far"), F.col("rest").alias("all"), F.posexplode("rest").alias("at", "feature"))
        left = found.select(*columns, "taken", F.expr("slice(all, at + 2, size(all))").alias("rest"), F.xxhash64("so_far", "feature").alias("key"))
        whole = left.filter(F.col("taken") == step).select(*columns, "key")
        out, left = whole if out is None else out.unionByName(whole), left.filter(F.col("taken") > step)
    return out


def _across(against: DataFrame, percent: int, scratch: Scratch, rows: int) -> DataFrame:
    """Pairs (family, a, b) in different components that may be linked, after all were compared with the middle of their family.

    A pair has a stranger in it, a member in another component than the middle.  The members
    of a family find each other by one shared feature, or by 2, 4 or 6 at once, the fewest
    that keep their pairs within ``PAIRS_A_MEMBER`` a member, as long as that takes no more than
    ``KEYS_A_MEMBER`` keys a member.  Any of these finds all pairs; where none keeps the
    bound, the last possible is taken, at any number of pairs.
    """
    members = _features(against, percent, scratch)
    left, chosen, found = members, {}, None
    for k in LEVELS:
        lists = scratch.stash(_lists(left, percent, k), f"feature-lists-{k}")
        count = F.expr("aggregate(sequence(1, taken), 1D, (n, i) -> n * (size(features) - taken + i) / i)")
        size = lists.groupBy("family").agg(F.countDistinct("rep").alias("members"), (F.sum(count) / F.countDistinct("rep")).alias("keys"))
        size = scratch.stash(size, f"family-keys-{k}", rows)
        light = size.filter((F.col("keys") <= KEYS_A_MEMBER) | F.lit(k == LEVELS[0]))
        pairs = _keys(lists.join(light.select("family"), "family", "left_semi"), k).groupBy("family", "kind", "key").agg((F.count_if("lower") * F.count_if(~F.col("lower")) / 2).alias("pairs"))
        cost = pairs.groupBy("family").agg(F.sum("pairs").alias("pairs")).join(light, "family")
        over = scratch.stash(cost.filter((F.col("pairs") > PAIRS_A_MEMBER * F.col("members")) & F.lit(k != LEVELS[-1])).select("family"), f"over-{k}", rows)
        heavy = size.join(light, "family", "left_anti").select("family")
        chosen[k] = (lists, scratch.stash(light.join(over, "family", "left_anti").select("family"), f"done-{k}", rows))
        if k != LEVELS[0]:
            before = LEVELS[LEVELS.index(k) - 1]
            old, done = chosen[before]
            chosen[before] = (old, done.unionByName(heavy))
        if over.isEmpty():
            break
        left = members.join(over, "family", "left_semi")
    for k, (lists, done) in chosen.items():
        keyed = scratch.stash(_keys(lists.join(done, "family", "left_semi"), k), f"feature-keys-{k}")
        side = lambda s, lower: keyed.filter(F.col("lower") == lower).select("family", "kind", "key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "c", "g")))  # noqa: E731,B023
        pairs = side("a", True).join(side("b", False), ["family", "kind", "key"]).filter("c_a != c_b AND (g_a < g_b OR (g_a = g_b AND rep_a < rep_b))")
        pairs = pairs.select("family", F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("family").alias("family"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, counted: dict[str, int] | None = None) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts with equal sets are linked; those without words, and rows whose doc_id is
    null, are linked with nothing and kept.  Rows that repeat a doc_id with its text
    share its result; a doc_id with several texts has the links of all.  An empty table
    gives no rows; other columns are not read; whole texts are, however long.
    Bands of 4 bins in 128 miss a pair at a similarity of 0.8 once in about 2e7.
    ``counted`` takes the numbers of pairs that the rounds compared.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    signed, _ = stash(signatures(docs, words, percent, bands, rows), "signatures")
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = scratch.stash(classes, "classes")

    # Buckets of more than one set, each with its hub.
    rare = signed.filter(F.size("keys") > 0).join(classes.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    keyed = rare.select(F.struct(F.xxhash64("doc_id").alias("x"), F.col("doc_id").alias("rep")).alias("place"), F.explode("keys").alias("key"))
    hubs = scratch.stash(keyed.groupBy("key").agg(F.min("place").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "hub"), "hubs")
    mates = scratch.stash(keyed.join(hubs, "key").select("hub", F.col("place.rep").alias("rep")).filter("hub.rep != rep").distinct(), "mates")
    met = mates.count()

    # Round 1: the best hub of each.
    # Joined by merging at every size: it spills where it must, and a small run shows what a large one does.
    needed = mates.select(F.col("rep").alias("doc_id")).unionByName(mates.select(F.col("hub.rep").alias("doc_id"))).distinct()
    sets = scratch.stash(_sets(docs.join(needed.hint("merge"), "doc_id", "left_semi"), words).distinct(), "sets")
    best = mates.groupBy("rep").agg(F.min("hub").alias("hub")).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"))
    first = scratch.stash(_confirm(best, sets, percent), "round-1")
    links = first.filter("linked").select("a", "b")
    labels = scratch.stash(components(links), "labels-1", 2 * met)

    # Round 2: the members of the hubs of one component, where they are in several: each with the middle of them.
    hub_label = labels.withColumnsRenamed({"node": "hub", "component": "family"})
    family = mates.select(F.col("hub.rep").alias("hub"), "rep").join(hub_label, "hub", "left").withColumn("family", F.coalesce("family", "hub"))
    family = family.select("family", "rep").unionByName(family.select("family", F.col("hub").alias("rep"))).distinct()
    member = family.join(labels.withColumnsRenamed({"node": "rep", "component": "c"}), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    uneasy = scratch.stash(member.groupBy("family").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x != y").select("family"), "uneasy-families", 2 * met)
    pairs = {"hub": first}
    if not uneasy.isEmpty():
        member = _merged(scratch.stash(member.join(uneasy, "family"), "members"), scratch, 2 * met)
        cores = scratch.stash(_cores(member, sets), "cores")
        against = scratch.stash(_against_core(member, cores, sets), "against-cores")
        away = F.expr(f"{percent} * n + {100 + percent} * m")
        middle = against.groupBy("family").agg(F.min(F.struct(away.alias("away"), "rep")).alias("x")).select("family", F.col("x.rep").alias("middle"))
        middle = scratch.stash(middle, "middles", 2 * met)
        at = middle.join(labels.withColumnsRenamed({"node": "middle", "component": "cm"}), "middle", "left").select("family", "middle", F.coalesce("cm", "middle").alias("cm"))
        of_middle = against.join(at.withColumnsRenamed({"middle": "rep"}), ["family", "rep"])
        of_middle = _salted(of_middle.select("family", "salts", F.col("rep").alias("b"), F.col("cm").alias("cb"), *(F.col(c).alias(f"{c}_b") for c in ("n", "m", "d"))))
        spokes = against.join(of_middle, ["family", "salt"]).filter("rep != b AND c != cb").select(F.col("rep").alias("a"), "b", "nc", *(F.col(c).alias(f"{c}_a") for c in ("n", "m", "d")), "n_b", "m_b", "d_b")
        pairs["middle"] = second = scratch.stash(spokes.select("a", "b", _linked(percent).alias("linked")), "round-2")
        links = links.unionByName(second.filter("linked").select("a", "b"))
        labels = scratch.stash(components(links), "labels-2", 2 * met)

        # Round 3: members that the middle does not tie, with others of their family in other components.
        named = labels.withColumnsRenamed({"node": "rep", "component": "now"})
        against = against.join(named, "rep", "left").withColumn("c", F.coalesce("now", "rep")).drop("now")
        home = middle.join(labels.withColumnsRenamed({"node": "middle", "component": "home"}), "middle", "left").join(cores.select("family", "salts"), "family")
        home = scratch.stash(home.select("family", F.coalesce("home", "middle").alias("home"), "salts"), "homes", 2 * met)
        against = scratch.stash(against.join(_salted(home), ["family", "salt"]).withColumn("strange", F.col("c") != F.col("home")).drop("home"), "against-middles")
        strange = scratch.stash(against.filter("strange").select("family", "salts").distinct(), "strange-families", 2 * met)
        if not strange.isEmpty():
            across = scratch.stash(_across(against.join(_salted(strange), ["family", "salt"]), percent, scratch, 2 * met), "across")
            pairs["beyond"] = third = scratch.stash(_confirm_beyond(across, against, percent), "round-3")
            new = third.filter("linked").select("a", "b")
            if not new.isEmpty():
                labels = scratch.stash(components(links.unionByName(new)), "labels-3", 2 * met)
    if counted is not None:
        counted.update({name: df.count() for name, df in pairs.items()})

    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    of_class, _ = stash(of_class, "class-labels")
    scratch.clear()
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` but for those that ``near_duplicates`` doesn't keep, with all their columns; extra ones may have any name.

    Of rows equal in doc_id and text one stays.  A row leaves for its own text, so a
    repeated doc_id does not take other texts along; rows of a repeated or null doc_id
    are preferred to others of their group.  Texts without words all stay, of long ones
    nothing is left out, and an empty table stays empty.
    """
    return drop_rows(docs, lambda rows: near_duplicates(rows, words, percent).filter("NOT kept").select("doc_id"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
