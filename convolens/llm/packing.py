"""Items packed into containers of fixed capacity by non-negative least squares over a histogram of sizes.

Only the histogram of item sizes (at most ``capacity`` numbers, whatever the data) comes to the driver. Sizes are put
into classes of about equal mass, fewer where there are few containers to fill. Combinations of up to three classes, of
two with any numbers of items, whose sum lies in a window below the capacity are enumerated; non-negative least squares
finds how often each is repeated to use up the classes; the counts are rounded and made of real sizes, the last item
being the one that fills best. What is left is solved again while it fills containers, and the rest is packed greedily,
best fit first, still as counts of sizes. The plan is a list of patterns with repeat counts, and each item finds its
container by its size and its rank among the items of that size.

An item larger than the capacity is cut into full pieces and a rest; no other item is cut.

Results for odd input: null and empty texts have no tokens and come out with a null bin_no; repeated rows are items of
their own; ties of size go by salted rank; null, zero or negative capacities give no rows; empty tables give no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from convolens.llm.tokenizer import count_tokens
from convolens.session import Stage, table

#: Classes of sizes at most, and for each container to fill; combinations kept for a pair of classes.
CLASSES, CLASSES_A_BIN, KEPT = 48, 0.3, 2
#: What a combination of classes may leave free, as part of the capacity; and one of real sizes, solution by solution.
WINDOW = 1 / 32
FREE = (1 / 512, 1 / 256, 1 / 128, 1 / 128, 1 / 96, 1 / 64)
#: Power of its mean size by which what a solution leaves of a class counts.
LONG = 3
#: Parts into which the items of one size are split to be ranked: at least, and items of a part, about.
SALTS, SALT_ITEMS = 16, 100_000


def combinations(means: list[float], capacity: int) -> list[dict[int, int]]:
    """Numbers of items by class, of up to three classes, that fill all but a window of the capacity; means are rising."""
    out: list[dict[int, int]] = []
    free = capacity * WINDOW
    m = len(means)
    for b in range(m):
        k = int(capacity // means[b])
        if k and capacity - k * means[b] <= free:
            out.append({b: k})
        for a in range(b):
            best = []
            for i in range(1, k + 1):
                room = capacity - i * means[b]
                j = int(room // means[a])
                if j and room - j * means[a] <= free:
                    best.append((room - j * means[a], i, j))
            out += [{b: i, a: j} for _, i, j in sorted(best)[:KEPT]]
            for c in range(a):
                if 0 <= capacity - means[a] - means[b] - means[c] <= free:
                    out.append({b: 1, a: 1, c: 1})
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0 by active sets: the column that helps most enters, negative ones leave."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    least = 1e-9 * max(1.0, float(np.abs(a.T @ b).max()))
    for _ in range(rounds):
        grad = a.T @ (b - a @ x)
        grad[active] = -np.inf
        j = int(grad.argmax())
        if grad[j] <= least:
            break
        active.append(j)
        while active:
            s = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[active] = s
                break
            cur = x[active]
            down = s <= 0
            step = float(np.min(cur[down] / np.maximum(cur[down] - s[down], 1e-300)))
            x[active] = cur + step * (s - cur)
            active = [k for k in active if x[k] > 1e-12]
            x[[k for k in range(len(x)) if k not in active]] = 0
    return x


class Plan:
    """Patterns (repeat count, {size: copies}) that hold all items of a histogram."""

    def __init__(self, capacity: int, histogram: dict[int, int]):
        self.capacity = capacity
        self.left = {s: c for s, c in histogram.items() if c}
        self.sizes = sorted(self.left)
        self.patterns: list[list] = []  # [repeats, free, {size: copies}]
        self.solved = 0  # tokens placed by least squares
        if self.left:
            for free in FREE:
                self._fill(int(capacity * free))
            self._pack()

    def _fill(self, free: int) -> None:
        """Makes the combinations of one least-squares solution of real sizes, if they leave at most ``free``."""
        sizes = [s for s in self.sizes if self.left[s]]
        mass = np.array([s * self.left[s] for s in sizes], float)
        bins = mass.sum() / self.capacity
        if bins < 2:
            return
        n = int(np.clip(bins * CLASSES_A_BIN, 4, CLASSES))
        of = np.minimum(((np.cumsum(mass) - mass / 2) / mass.sum() * n).astype(int), n - 1)
        classes = [[s for s, c in zip(sizes, of) if c == k] for k in np.unique(of)]
        count = np.array([sum(self.left[s] for s in x) for x in classes], float)
        means = [sum(s * self.left[s] for s in x) / c for x, c in zip(classes, count)]
        combos = combinations(means, self.capacity)
        if sum(self.left[s] for s in sizes if 2 * s > self.capacity) >= bins:
            # each item over half the capacity needs a container, and these have room for all others
            combos = [c for c in combos if any(2 * classes[g][0] > self.capacity for g in c)]
        if not combos:
            return
        a = np.zeros((len(classes), len(combos)))
        for j, combo in enumerate(combos):
            for g, k in combo.items():
                a[g, j] = k
        weight = np.array(means)[:, None] ** LONG  # what is left of long items is harder to place
        x = nnls(a * weight, count * weight[:, 0])
        for j in np.argsort(-x, kind="stable"):
            self._repeat(combos[j], int(x[j] + 0.5), classes, free)

    def _repeat(self, combo: dict[int, int], times: int, classes: list[list[int]], free: int) -> None:
        """Makes a combination of real sizes ``times`` times: long and short ones of each class in turn, and last what fills the rest best."""
        while times > 0:
            chosen: dict[int, int] = {}
            room = self.capacity
            wanted = [g for g, k in combo.items() for _ in range(k)]  # the longest class first
            for i, g in enumerate(wanted[:-1]):
                own = classes[g]
                while own and not self.left[own[-1]]:
                    own.pop()
                while own and not self.left[own[0]]:
                    own.pop(0)
                s = next((s for s in (reversed(own) if i % 2 else own) if chosen.get(s, 0) < self.left[s] and s <= room), None)
                if s is None:
                    return
                chosen[s] = chosen.get(s, 0) + 1
                room -= s
            at = bisect.bisect_right(self.sizes, room) - 1
            while at >= 0 and self.left[self.sizes[at]] <= chosen.get(self.sizes[at], 0):
                if not self.left[self.sizes[at]]:
                    del self.sizes[at]
                at -= 1
            # what would leave more free than a combination may is left for the next solution
            if at < 0 or room - self.sizes[at] > free:
                return
            s = self.sizes[at]
            chosen[s] = chosen.get(s, 0) + 1
            n = min(times, *(self.left[s] // k for s, k in chosen.items()))
            for s, k in chosen.items():
                self.left[s] -= n * k
                self.solved += n * k * s
            self.patterns.append([n, self.capacity - sum(s * k for s, k in chosen.items()), chosen])
            times -= n

    def _pack(self) -> None:
        """Best fit decreasing over counts: as many copies as fit go where the least room is enough."""
        free = sorted((p[1], i) for i, p in enumerate(self.patterns))
        for s in sorted(self.left, reverse=True):
            c = self.left[s]
            while c:
                at = bisect.bisect_left(free, (s, -1))
                if at == len(free):
                    k = self.capacity // s
                    n, rest = divmod(c, k)
                    for times, copies in ((n, k), (1 if rest else 0, rest)):
                        if times:
                            self.patterns.append([times, self.capacity - s * copies, {s: copies}])
                            bisect.insort(free, (self.capacity - s * copies, len(self.patterns) - 1))
                    c = 0
                    break
                room, i = free.pop(at)
                p = self.patterns[i]
                k = min(room // s, c)
                n = min(p[0], c // k)
                if n < p[0]:
                    self.patterns.append([p[0] - n, room, dict(p[2])])
                    bisect.insort(free, (room, len(self.patterns) - 1))
                self.patterns[i] = [n, room - k * s, p[2] | {s: p[2].get(s, 0) + k}]
                bisect.insort(free, (room - k * s, i))
                c -= n * k
            self.left[s] = 0

    def slots(self) -> tuple[np.ndarray, ...]:
        """Sorted by size and first rank: size, first rank of the slots, copies a container, first container."""
        rows, first, used = [], 0, {}
        for n, _, sizes in self.patterns:
            for s, k in sizes.items():
                rows.append((s, used.get(s, 0), k, first))
                used[s] = used.get(s, 0) + n * k
            first += n
        self.bins = first
        rows.sort()
        return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def _place(broadcast):
    def run(batches):
        plans = broadcast.value
        for batch in batches:
            caps = batch["capacity"].to_numpy()
            size, rank = batch["size"].to_numpy(), batch["rank"].to_numpy()
            bins = np.full(len(caps), -1, np.int64)
            for c in np.unique(caps):
                rows = np.flatnonzero((caps == c) & (size > 0))
                if not len(rows):
                    continue
                s, r, k, f = plans[int(c)]
                key = s << 40 | r
                at = np.searchsorted(key, size[rows] << 40 | rank[rows], "right") - 1
                bins[rows] = f[at] + (rank[rows] - r[at]) // k[at]
            cols = {n: batch[n] for n in batch.schema.names if n not in ("capacity", "size", "rank", "salt")}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(bins, mask=bins < 0)], [*cols, "bin_no"])

    return run


def pack(spark: SparkSession, items: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container, bin_no, doc_id, part, start_token, n_tokens): items (doc_id, n) in containers of each capacity.

    capacities (container, capacity_tokens) is a dimension of a few rows.
    """
    stage = Stage(spark, "packing")
    items = stage.keep(items)
    dims = [(r.container, int(r.capacity_tokens)) for r in capacities.where("capacity_tokens > 0 and container is not null").select("container", "capacity_tokens").distinct().collect()]
    spread = F.explode(F.array(*(F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in dims))) if dims else None
    if spread is None:
        return spark.createDataFrame([], "container string, bin_no bigint, doc_id bigint, part int, start_token bigint, n_tokens bigint")
    each = items.select("doc_id", F.col("n").cast("bigint").alias("n"), spread.alias("c")).select("c.*", "doc_id", "n")
    # full pieces of long items, and the rest (of an item that fits: itself)
    full = F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    each = each.withColumn("full", full).withColumn("size", F.col("n") - F.col("full") * F.col("capacity"))
    # a size that many items have is cut into parts of bounded size to be ranked
    most = stage.keep(each.groupBy("container", "capacity", "size", "full").agg(F.count("*").alias("rows")))
    top = most.groupBy("container", "size").agg(F.sum("rows").alias("rows")).agg(F.max("rows")).first()[0] or 0
    long = most.where("full > 0").groupBy("container").agg(F.sum("rows").alias("rows")).agg(F.max("rows")).first()[0] or 0
    salts = max(SALTS, -(-max(top, long) // SALT_ITEMS))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts)))
    keys = ["container", "capacity", "size", "salt"]
    counts = stage.keep(salted.groupBy(*keys).agg(F.count("*").alias("rows")))
    plans: dict[int, dict[int, int]] = {c: {} for _, c in dims}
    one = list({c: n for n, c in dims}.values())  # containers of equal capacity have equal plans
    for r in counts.where(F.col("container").isin(one) & (F.col("size") > 0)).groupBy("capacity", "size").agg(F.sum("rows").alias("rows")).collect():
        plans[int(r.capacity)][int(r["size"])] = int(r["rows"])
    made = {c: Plan(c, h) for c, h in plans.items()}
    slots = {c: p.slots() for c, p in made.items()}
    first_full = {c: getattr(p, "bins", 0) for c, p in made.items()}
    # rank of each item among those of its size: inside its salt, after the salts before it. Both sides of the join are
    # parted by the same keys, so the items aren't shuffled again
    w = W.partitionBy("container", "capacity", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("before"))
    inside = W.partitionBy(*keys).orderBy("doc_id")
    ranked = salted.withColumn("rn", F.row_number().over(inside)).join(offsets.hint("merge"), keys)
    ranked = ranked.select("container", "capacity", "doc_id", "n", "full", "size", (F.col("before") + F.col("rn") - 1).cast("bigint").alias("rank"))
    placed = ranked.mapInArrow(_place(spark.sparkContext.broadcast(slots)), "container string, doc_id bigint, n bigint, full int, bin_no bigint")
    cap = F.create_map(*(x for n, c in dims for x in (F.lit(n), F.lit(c).cast("bigint"))))[F.col("container")]
    start = F.col("full") * cap
    rest = placed.select("container", "bin_no", "doc_id", F.col("full").alias("part"), start.cast("bigint").alias("start_token"), (F.col("n") - start).cast("bigint").alias("n_tokens")).where("n_tokens > 0 or part = 0")
    # full pieces have containers of their own, numbered after the planned ones: by items' salts, then inside them
    longs = each.where("full > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts)))
    tops = longs.groupBy("container", "salt").agg(F.sum("full").alias("k"))
    tops = tops.select("container", "salt", F.coalesce(F.sum("k").over(W.partitionBy("container").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = F.coalesce(F.sum("full").over(W.partitionBy("container", "salt").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = F.create_map(*(x for n, c in dims for x in (F.lit(n), F.lit(first_full[c]).cast("bigint"))))[F.col("container")]
    pieces = longs.withColumn("mine", run).join(tops.hint("merge"), ["container", "salt"])
    pieces = pieces.select("container", "doc_id", "capacity", (base + F.col("before") + F.col("mine")).alias("b"), F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"))
    pieces = pieces.select("container", (F.col("b") + F.col("part")).cast("bigint").alias("bin_no"), "doc_id", "part", (F.col("part") * F.col("capacity")).cast("bigint").alias("start_token"), F.col("capacity").alias("n_tokens"))
    return rest.unionByName(pieces)


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    items = docs.select("doc_id", count_tokens(F.col("text")).alias("n"))
    return pack(spark, items, table(spark, sf_dir, "capacities"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, n_bins, n_tokens, fill): how full the containers are, full pieces of long texts included."""
    packed = p8_pack(spark, sf_dir).where("bin_no is not null")
    caps = table(spark, sf_dir, "capacities").select("container", "capacity_tokens")
    sums = packed.groupBy("container").agg(F.countDistinct("bin_no").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    return sums.join(F.broadcast(caps), "container").select("container", "n_bins", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("fill"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, n_documents, n_overfull, n_split, n_lost): what packing must keep: every document once, none over the capacity, split only where it must be."""
    packed = p8_pack(spark, sf_dir)
    caps = table(spark, sf_dir, "capacities").select("container", "capacity_tokens")
    # one row a document and a container: its parts, their tokens, and whether they follow each other
    docs = packed.groupBy("container", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"), (F.max(F.col("start_token") + F.col("n_tokens")) == F.sum("n_tokens")).alias("whole"))
    docs = docs.join(F.broadcast(caps), "container").groupBy("container").agg(F.count("*").alias("n_documents"), F.count_if((F.col("parts") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("n_split"), F.count_if(~F.col("whole")).alias("n_lost"))
    bins = packed.where("bin_no is not null").groupBy("container", "bin_no").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(caps), "container").groupBy("container").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_overfull"))
    return docs.join(bins, "container", "left").fillna(0, ["n_overfull"]).select("container", "n_documents", "n_overfull", "n_split", "n_lost")
