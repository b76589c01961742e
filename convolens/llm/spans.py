"""Long spans shared word for word between records, by a sparse de Bruijn graph that Spark joins compact.

Tokens are code points, for spans are counted in them and scripts without spaces have no other. The k-mers (k = ``K``)
are the edges of the graph; of each window of consecutive k-mers only the one of least hash is kept, which keeps the
same edges of equal texts, and at least one of every span of ``LEAST`` code points. Edges of two or more different
texts are the repeated ones. A repeated edge and the next one of all its texts, at the same distance and with no other
successor or predecessor, are one path: such nonbranching paths are compacted by pointer doubling (self-joins). The
sources of a path are its texts with their coordinates; where the coordinates alone don't show a span of LEAST, the
windows of LEAST code points that hold one of the path's edges and reach over its ends are compared by their hashes.

Equal texts are one class and are not compared with each other. All pairs of records with different texts are written
out. Those of equal texts are, for classes of up to ``EXPAND`` members; in a larger class the first member is paired with
each other one, and the query p6_members has all members.

Results for odd input: null texts and texts shorter than LEAST share nothing; null ids are left out; repeated rows are
one record; all rows of one episode_id are one record; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from convolens.llm.batches import slices
from convolens.llm.langid import code_points
from convolens.operators.intervals import periods
from convolens.session import Stage, is_empty, table

#: Least length of a span, length of a k-mer, and k-mers of a window (so a span holds a whole window).
LEAST, K = 200, 120
WINDOW = LEAST - K + 1
#: Copies of one text up to which all their pairs are written out.
EXPAND = 64
#: Members of a group that one block of its pairs holds of the one side, about.
MEMBERS = 128
#: Rows of a side that is broadcast, at most, and values of its arrays; beyond that both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Code points hashed at a time; a longer text is a block of its own.
BLOCK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n modulo 2**64, and their inverses."""
    size = 1 << max(19, int(n).bit_length())
    if size not in _powers:
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(cps: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k code points."""
    up, down = powers(len(cps) + 1)
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(0x51ED27)) * up[: len(cps)], out=sums[1:])
    n = len(cps) - k + 1
    return mixed((sums[k:] - sums[:n]) * down[:n])


def _sliding(x: np.ndarray, width: int, op, fill) -> np.ndarray:
    """op over x[i : i + width], for every i (shorter at the end)."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = op(out[:-step], out[step:])
        have += step
    return out


def sparse_kmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept k-mers of texts: text number, position, hash; sorted by text and position."""
    long = [i for i, t in enumerate(texts) if len(t) >= LEAST]
    if not long:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cps, starts = code_points([texts[i] for i in long])
    h = gram_hashes(cps, K)
    n = len(h)
    low = _sliding(h, WINDOW, np.minimum, None)
    valid = np.zeros(n + 1, np.int8)
    valid[starts[:-1]] = 1
    stop = starts[1:] - 1 - LEAST + 1  # first window start that would cross the text's end
    valid[np.minimum(stop, n)] -= 1
    ok = np.cumsum(valid[:-1], dtype=np.int8) > 0
    low[~ok] = 0
    # the greatest minimum of the windows that hold position p is its own hash just if one of them keeps it
    high = _sliding(low[::-1], WINDOW, np.maximum, None)[::-1]
    at = np.flatnonzero((high == h) & (h > 0))
    owner = np.searchsorted(starts, at, "right") - 1
    return np.array(long, np.int64)[owner], at - starts[owner], h[at].view(np.int64)


def text_class(text: str) -> int:
    """64 bits that stand for a text."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=len(text)) - (1 << 63)


def repeats(owner: np.ndarray, pos: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of k-mers which to keep, and rep: -1 if no other place of the k-mer overlaps, else how far the places left out after it reach.

    Places of one k-mer at equal distances below K lie in text of that period. WINDOW away from both ends of such a run
    the windows of LEAST that hold a place are the same at all of them, so the first of these stands for the others.
    """
    n = len(owner)
    keep, rep = np.ones(n, bool), np.full(n, -1, np.int64)
    order = np.lexsort((pos, h, owner))
    o, x, at = owner[order], h[order], pos[order]
    gap = at[1:] - at[:-1]
    near = (o[1:] == o[:-1]) & (x[1:] == x[:-1]) & (gap < K)
    touched = np.flatnonzero(np.r_[near, False] | np.r_[False, near])
    rep[order[touched]] = 0
    js = np.flatnonzero(near)
    if len(js):
        # runs of equal gaps: from place first to place last
        cut = np.flatnonzero((js[1:] != js[:-1] + 1) | (gap[js[1:]] != gap[js[:-1]])) + 1
        for first, last in zip(js[np.r_[0, cut]], js[np.r_[cut, len(js)] - 1] + 1):
            deep = first + np.flatnonzero((at[first : last + 1] - at[first] >= WINDOW) & (at[last] - at[first : last + 1] >= WINDOW))
            if len(deep) > 1:
                keep[order[deep[1:]]] = False
                rep[order[deep[0]]] = at[deep[-1]] - at[deep[0]]
    return keep, rep


def _blocks(texts: list[str]):
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > BLOCK:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _sketch(batches):
    """(rec, text) to (rec, cls, n_chars, kmers): the kept k-mers of each text, with rep as in repeats()."""
    kmer = pa.list_(pa.struct([("kmer", pa.int64()), ("pos", pa.int32()), ("no", pa.int32()), ("rep", pa.int32())]))
    for batch in slices(batches):
        recs, texts = batch["rec"].to_pylist(), batch["text"].to_pylist()
        for a, b in _blocks(texts):
            part = texts[a:b]
            owner, pos, h = sparse_kmers(part)
            keep, rep = repeats(owner, pos, h)
            owner, pos, h, rep = owner[keep], pos[keep], h[keep], rep[keep]
            heads = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
            no = np.arange(len(owner)) - np.repeat(heads[:-1], np.diff(heads))
            items = pa.StructArray.from_arrays([pa.array(h), pa.array(pos.astype(np.int32)), pa.array(no.astype(np.int32)), pa.array(rep.astype(np.int32))], ["kmer", "pos", "no", "rep"])
            lists = pa.ListArray.from_arrays(pa.array(heads), items)
            assert lists.type == kmer
            yield pa.RecordBatch.from_arrays([pa.array(recs[a:b]), pa.array([text_class(t) for t in part], pa.int64()), pa.array([len(t) for t in part], pa.int32()), lists], ["rec", "cls", "n_chars", "kmers"])


def records(docs: DataFrame, episodes: DataFrame) -> DataFrame:
    """(rec, text): documents as d<doc_id>, and the different descriptions of each episode."""
    d = docs.where("doc_id is not null and text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("rec"), "text")
    e = episodes.where("episode_id is not null and description is not null").select(F.col("episode_id").alias("rec"), F.col("description").alias("text"))
    return d.unionByName(e)


def small(df: DataFrame, array: str | None = None) -> DataFrame:
    """The frame with a broadcast hint if it has at most BROADCAST_ROWS rows, or items of its array (counted; df should be a written table)."""
    size = df.agg(F.count("*") if array is None else F.coalesce(F.sum(F.size(array) + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


class SharedSpans:
    """The stages of one run; each is a written table."""

    def __init__(self, spark: SparkSession, source: DataFrame):
        self.spark, self.stage, self.source = spark, Stage(spark, "spans"), source
        self.sketch = self.stage.keep(source.where(f"length(text) >= {LEAST}").mapInArrow(_sketch, "rec string, cls bigint, n_chars int, kmers array<struct<kmer:bigint,pos:int,no:int,rep:int>>"))
        self.classes = self.sketch.select("rec", "cls", "n_chars").distinct()
        self.sources = self._repeated()
        self.paths = self._compact()

    def _repeated(self) -> DataFrame:
        """(kmer, cls, pos, no, rep): the k-mers that two or more classes hold, with all their sources."""
        flat = self.sketch.select("cls", F.inline("kmers"))
        ends = flat.groupBy("kmer").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
        twice = self.stage.keep(ends.where("lo != hi").select("kmer"))
        found = flat.join(small(twice), "kmer", "left_semi")
        return self.stage.keep(found.distinct())

    def _compact(self) -> DataFrame:
        """(path, cls, start, end, reach): nonbranching paths of repeated k-mers with their sources' coordinates.

        A source with a reach stands for others like it that follow, up to so many code points further on.
        """
        w = W.partitionBy("cls").orderBy("no")
        after = self.sources.select("kmer", "cls", F.lead("kmer").over(w).alias("nk"), (F.lead("pos").over(w) - F.col("pos")).alias("gap"), (F.lead("no").over(w) - F.col("no")).alias("steps"), (F.greatest("rep", F.lead("rep").over(w)) < 0).alias("apart"))
        # what follows in each source: the next kept k-mer if it is repeated too, else nothing
        linked = after.where(f"steps = 1 and gap < {K} and apart").groupBy("kmer", "nk", "gap").agg(F.count("*").alias("n"))
        n = self.sources.groupBy("kmer").agg(F.count("*").alias("all"))
        j = linked.join(n, "kmer").join(n.select(F.col("kmer").alias("nk"), F.col("all").alias("all_next")), "nk")
        links = j.where("n = all and n = all_next").select("kmer", "nk", "gap")
        # pointers lead to the predecessor; doubling makes them lead to the head of the path, dist code points before.
        # no path is a ring, for in each text some occurrence is the last and has no successor
        ptr = self.stage.keep(links.select(F.col("nk").alias("kmer"), F.col("kmer").alias("ptr"), F.col("gap").alias("dist")))
        while not is_empty(ptr):
            step = ptr.alias("a").join(ptr.alias("b"), F.col("a.ptr") == F.col("b.kmer"), "left")
            nxt = self.stage.keep(step.select("a.kmer", F.coalesce("b.ptr", "a.ptr").alias("ptr"), (F.col("a.dist") + F.coalesce("b.dist", F.lit(0))).alias("dist"), F.col("b.ptr").isNotNull().alias("moved")))
            done = is_empty(nxt.where("moved"))
            self.stage.drop(ptr)
            ptr = nxt
            if done:
                break
        heads = self.sources.join(ptr.select("kmer", "ptr", "dist"), "kmer", "left")
        heads = heads.select(F.coalesce("ptr", "kmer").alias("path"), "cls", (F.col("pos") - F.coalesce("dist", F.lit(0))).alias("start"), "pos", "rep")
        return self.stage.keep(heads.groupBy("path", "cls", "start").agg((F.max("pos") + K).alias("end"), F.greatest(F.max("rep"), F.lit(0)).alias("reach")))

    def windows(self, edges: bool) -> DataFrame:
        """(path, cls, pos, reach, h): the windows of LEAST code points at pos that hold a k-mer of the path, by their hashes.

        Those of paths under LEAST; with edges, of longer paths too, but for the windows that lie in the path.
        """
        long, lo, hi = F.expr(f"end - start >= {LEAST}"), F.col("start") - (WINDOW - 1), F.col("end") - K
        spot = lambda a, b: F.struct("path", a.cast("int").alias("lo"), b.cast("int").alias("hi"), "reach")
        spots = F.when(~long, F.array(spot(lo, hi)))
        if edges:
            spots = spots.otherwise(F.array(spot(lo, F.col("start") - 1), spot(F.col("end") - LEAST + 1, hi)))
        need = self.paths.select("cls", F.explode(spots).alias("spot"))
        # one record of each class lends its text
        lender = self.classes.groupBy("cls").agg(F.min("rec").alias("rec"))
        wanted = self.stage.keep(need.groupBy("cls").agg(F.collect_set("spot").alias("spots")).join(lender, "cls"))
        lent = self.source.where(f"length(text) >= {LEAST}").join(small(wanted, "spots"), "rec")
        cut = lent.select("cls", "text", "spots").mapInArrow(_windows, "path bigint, cls bigint, pos int, reach int, h bigint")
        # repeated rows of the source lend a text more than once
        return self.stage.keep(cut.groupBy("path", "cls", "pos", "h").agg(F.max("reach").alias("reach")) if edges else cut.select("path", "cls", "h").distinct())

    def linked(self) -> DataFrame:
        """(cls_a, cls_b): all pairs of different texts that share a span of LEAST."""
        long = self.paths.where(f"end - start >= {LEAST}").select("path", "cls", F.lit(0).cast("bigint").alias("h")).distinct()
        groups = long.unionByName(self.windows(False).select("path", "cls", "h"))
        # groups of the same texts are paired once; their fingerprints are counted by partial sums
        marks = ["_n", "_lo", "_hi", "_x", "_y"]
        sized = groups.groupBy("path", "h").agg(F.count("*").alias("_n"), F.min("cls").alias("_lo"), F.max("cls").alias("_hi"), F.bit_xor(F.xxhash64("cls")).alias("_x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("_y")).where("_n > 1")
        sets = self.stage.keep(sized.groupBy(*marks).agg(F.min(F.struct("path", "h")).alias("_g")).select("_g.*", *marks))
        two = sets.where("_n = 2").select(F.col("_lo").alias("cls_a"), F.col("_hi").alias("cls_b"))
        # the members of a group are one side in blocks and the other side whole in each block, so no task holds all pairs
        blocks = F.ceil(F.col("_n") / F.lit(MEMBERS)).cast("int")
        held = groups.join(small(sets.where("_n > 2").select("path", "h", blocks.alias("_b"))), ["path", "h"])
        held = self.stage.keep(held.select("path", "h", "cls", "_b"))
        a = held.select("path", "h", F.col("cls").alias("cls_a"), F.pmod(F.xxhash64("cls"), F.col("_b").cast("bigint")).cast("int").alias("_k"))
        b = held.select("path", "h", F.col("cls").alias("cls_b"), F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_k"))
        return two.unionByName(a.join(b, ["path", "h", "_k"]).where("cls_a < cls_b").select("cls_a", "cls_b")).distinct()

    def covered(self) -> DataFrame:
        """(cls, s_ms, e_ms): what of each text other texts hold too, in pieces that may overlap."""
        whole = self.paths.where(f"end - start >= {LEAST}").select("cls", F.col("start").alias("s_ms"), F.col("end").alias("e_ms"))
        w = self.windows(True)
        twice = self.stage.keep(w.groupBy("path", "h").agg(F.min("cls").alias("_lo"), F.max("cls").alias("_hi")).where("_lo != _hi").select("path", "h"))
        # windows that begin so near to each other overlap
        held = w.join(twice, ["path", "h"], "left_semi").groupBy("path", "cls", F.expr(f"pos div {LEAST // 2}")).agg(F.min("pos").alias("s_ms"), (F.max(F.col("pos") + F.col("reach")) + LEAST).alias("e_ms"))
        pieces = whole.unionByName(held.select("cls", "s_ms", "e_ms"))
        return pieces.select("cls", F.col("s_ms").cast("bigint").alias("s_ms"), F.col("e_ms").cast("bigint").alias("e_ms")).distinct()


def _windows(batches):
    """(cls, text, spots) to (path, cls, pos, reach, h): the windows that begin in a spot, each once in a path."""
    names = ["path", "cls", "pos", "reach", "h"]
    for batch in slices(batches):
        for row in range(batch.num_rows):
            cls, text = batch["cls"][row].as_py(), batch["text"][row].as_py()
            if text_class(text) != cls:
                continue  # another text of the record
            spots = batch["spots"][row].values.flatten()
            path, lo, hi, reach = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spots)
            lo, hi = np.maximum(lo, 0), np.minimum(hi, len(text) - LEAST)
            n = np.maximum(hi - lo + 1, 0)
            pos = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            path, reach = np.repeat(path, n), np.repeat(reach, n)
            order = np.lexsort((-reach, pos, path))
            path, pos, reach = path[order], pos[order], reach[order]
            once = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (pos[1:] != pos[:-1])][: len(pos)])
            if not len(once):
                continue
            path, pos, reach = path[once], pos[once], reach[once]
            h = gram_hashes(code_points([text])[0][:-1], LEAST)[pos].view(np.int64)
            for a in range(0, len(pos), BLOCK):
                p = pos[a : a + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(path[a : a + BLOCK]), pa.array(np.full(len(p), cls, np.int64)), pa.array(p.astype(np.int32)), pa.array(reach[a : a + BLOCK].astype(np.int32)), pa.array(h[a : a + BLOCK])], names)


def _sized(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds the size of each row's group and its least value; counted by partial sums, so no group is ever held together."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias("_first")), key)


def _pairs(members: DataFrame, key: str) -> DataFrame:
    """Pairs of records of one class: all of them up to EXPAND members, else of the first with each other one."""
    sized = _sized(members, key, "rec")
    a = sized.where(f"_n > 1 and (_n <= {EXPAND} or rec = _first)").select(key, F.col("rec").alias("rec_a"))
    return a.join(members.select(key, F.col("rec").alias("rec_b")), key).where("rec_a < rec_b").select("rec_a", "rec_b")


def found(shared: SharedSpans) -> DataFrame:
    """(rec_a, rec_b): pairs of records that share a span."""
    members = shared.classes.select("cls", "rec").distinct()
    j = shared.linked().join(members.select(F.col("cls").alias("cls_a"), F.col("rec").alias("ra")), "cls_a").join(members.select(F.col("cls").alias("cls_b"), F.col("rec").alias("rb")), "cls_b")
    different = j.where("ra != rb").select(F.least("ra", "rb").alias("rec_a"), F.greatest("ra", "rb").alias("rec_b"))
    return different.unionByName(_pairs(members, "cls")).distinct()


def shares(shared: SharedSpans) -> DataFrame:
    """(rec, n_chars, shared_chars, share): how much of each record's text lies in spans that other records hold too.

    Copies are shared whole; of an episode with several descriptions the longest counts.
    """
    covered = periods(shared.covered(), ["cls"]).groupBy("cls").agg(F.sum(F.col("e_ms") - F.col("s_ms")).alias("shared_chars"))
    copies = shared.classes.groupBy("cls").agg(F.countDistinct("rec").alias("copies"))
    j = shared.classes.join(copies, "cls").join(covered, "cls", "left")
    j = j.withColumn("shared_chars", F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0))).cast("bigint"))
    top = j.groupBy("rec").agg(F.max(F.struct("n_chars", "shared_chars")).alias("x")).select("rec", "x.n_chars", "x.shared_chars")
    rest = shared.source.where(f"length(text) < {LEAST}").groupBy("rec").agg(F.max(F.length("text")).alias("n_chars")).join(top, "rec", "left_anti").select("rec", "n_chars", F.lit(0).cast("bigint").alias("shared_chars"))
    return top.unionByName(rest).withColumn("share", F.round(F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)), 6))


def members(shared: SharedSpans) -> DataFrame:
    """(path, rec, start_char, end_char): the repeated paths and where each record holds them; overlapping places of one k-mer are one.

    A text that several records have whole is a path of its own, and has all of them.
    """
    w = W.partitionBy("path", "cls").orderBy("start")
    reached = F.max(F.col("end") + F.col("reach")).over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = shared.paths.withColumn("_new", F.coalesce((F.col("start") >= reached) | (F.col("end") - F.col("start") > K), F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    places = islands.groupBy("path", "cls", "_island").agg(F.min("start").alias("start"), F.max(F.col("end") + F.col("reach")).alias("end"))
    named = shared.classes.select("cls", "rec").distinct()
    held = places.join(named, "cls").select("path", "rec", F.col("start").alias("start_char"), F.col("end").alias("end_char"))
    copied = shared.classes.groupBy("cls").agg(F.min("rec").alias("_lo"), F.max("rec").alias("_hi")).where("_lo != _hi").select("cls")
    copies = shared.classes.join(copied, "cls", "left_semi").select(F.col("cls").alias("path"), "rec", F.lit(0).alias("start_char"), F.col("n_chars").alias("end_char")).distinct()
    return held.unionByName(copies)


def shared_spans(spark: SparkSession, sf_dir: str) -> SharedSpans:
    return SharedSpans(spark, records(table(spark, sf_dir, "documents"), table(spark, sf_dir, "episodes")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(shared_spans(spark, sf_dir))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(shared_spans(spark, sf_dir))


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(shared_spans(spark, sf_dir))
