"""Association of the masks of many views to instances of Gaussians.

Every mask is a seed. All seeds go through the rounds at once: a round labels the Gaussians of each
seed by what they give to its masks so far, renders those Gaussians in the views that the seed has
not matched yet, and adds the mask of each such view that overlaps the rendering best. Sums over
views only grow, so that a seed is its matched masks and nothing else. Which seeds count, and which
Gaussians they take from each other, is decided afterwards in order of priority, a round for each
step of the longest chain of seeds that meet.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SEED = ["scene", "view", "mask"]
#: Refinements after the first match.
ROUNDS = 99
#: A seed whose Gaussians are claimed to more than CLAIMED, and of which one object holds SHARED or more, is part of that object.
CLAIMED, SHARED = 0.8, 0.6


def bounds(masks: DataFrame, width: int) -> DataFrame:
    """(scene, view, mask, x1, y1, x2, y2) of masks (scene, view, mask, px), ends included."""
    x, y = F.col("px") % width, F.floor(F.col("px") / width)
    return masks.groupBy(*SEED).agg(F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2"))


def labels_of(matched: DataFrame, given: DataFrame, seen: DataFrame, low: DataFrame) -> DataFrame:
    """(seed, pid) of Gaussians that give more to a seed's matched masks than to the rest of those views.

    given is (scene, view, mask, pid, c), what a Gaussian gives to a mask; seen (scene, view, pid, c)
    what it gives to a view. What low Gaussians (scene, pid) give to a seed's own mask does not count.
    """
    to_masks = matched.join(given, SEED)
    own = to_masks.join(low.withColumn("low", F.lit(True)), ["scene", "pid"], "left")
    counted = own.withColumn("c", F.when(F.col("own") & F.col("low").isNotNull(), 0.0).otherwise(F.col("c")))
    inside = counted.groupBy("seed", "scene", "pid").agg(F.sum("c").alias("inside")).filter("inside > 0")
    views = matched.select("seed", "scene", "view").distinct()
    whole = inside.join(views, ["seed", "scene"]).join(seen, ["scene", "view", "pid"]).groupBy("seed", "scene", "pid").agg(F.first("inside").alias("inside"), F.sum("c").alias("whole"))
    return whole.filter(F.col("inside") > F.col("whole") - F.col("inside")).select("seed", "scene", "pid")


def best_masks(labels: DataFrame, views: DataFrame, alphas: DataFrame, masks: DataFrame, boxes: DataFrame, sizes: DataFrame, width: int, threshold: float) -> DataFrame:
    """(seed, scene, view, mask, iou): of each view of views (seed, scene, view) the mask that overlaps the rendering of the seed's Gaussians best, over a threshold.

    A pixel is on where the Gaussians cover more than half of it. Only masks whose box meets the
    bounds of the rendering are compared, the first of equals is taken.
    """
    wanted = views.join(labels, ["seed", "scene"])
    lit = wanted.join(alphas, ["scene", "view", "pid"]).groupBy("seed", "scene", "view", "px").agg(F.sum(F.log1p(-F.col("alpha"))).alias("dark")).filter(F.col("dark") < math.log(0.5))
    lit = cut(lit.select("seed", "scene", "view", "px"))
    x, y = F.col("px") % width, F.floor(F.col("px") / width)
    frame = lit.groupBy("seed", "scene", "view").agg(F.count(F.lit(1)).alias("lit"), F.min(x).alias("u1"), F.min(y).alias("v1"), F.max(x).alias("u2"), F.max(y).alias("v2"))
    shared = lit.join(masks, ["scene", "view", "px"]).groupBy("seed", *SEED).agg(F.count(F.lit(1)).alias("both"))
    near = shared.join(frame, ["seed", "scene", "view"]).join(boxes, SEED).filter("u1 <= x2 and x1 <= u2 and v1 <= y2 and y1 <= v2").join(sizes, SEED)
    iou = near.withColumn("iou", F.col("both") / (F.col("lit") + F.col("n") - F.col("both"))).filter(F.col("iou") > threshold)
    best = iou.groupBy("seed", "scene", "view").agg(F.min(F.struct((-F.col("iou")).alias("k"), "mask")).alias("b"))
    return best.select("seed", "scene", "view", "b.mask", (-F.col("b.k")).alias("iou"))


def matched_rounds(seeds: DataFrame, alphas: DataFrame, weights: DataFrame, masks: DataFrame, boxes: DataFrame, low: DataFrame, width: int, threshold: float = 0.5, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(matches, labels) of seeds (seed, scene, view, mask): every mask that a seed has matched with the round it came in, and its Gaussians at the end.

    alphas is (scene, view, px, pid, alpha) of all Gaussians, weights (scene, view, px, pid, w)
    what each gives to a pixel when all are rendered. A seed without a Gaussian of its own has no
    label; one that matches nothing has its own mask only.
    """
    given = cut(weights.join(masks, ["scene", "view", "px"]).groupBy(*SEED, "pid").agg(F.sum("w").alias("c")))
    seen = cut(weights.groupBy("scene", "view", "pid").agg(F.sum("w").alias("c")))
    alphas, sizes = cut(alphas.select("scene", "view", "px", "pid", "alpha")), cut(masks.groupBy(*SEED).agg(F.count(F.lit(1)).alias("n")))
    views = masks.select("scene", "view").distinct()
    matches = cut(seeds.select("seed", *SEED, F.lit(True).alias("own"), F.lit(0).alias("round"), F.lit(1.0).alias("iou")))
    labels = cut(labels_of(matches, given, seen, low))
    live, done = labels, None
    for n in range(1, rounds + 2):
        met = matches.select("seed", "scene", "view")
        open_views = live.select("seed", "scene").distinct().join(views, "scene").join(met, ["seed", "scene", "view"], "left_anti")
        new = cut(best_masks(live, open_views, alphas, masks, boxes, sizes, width, threshold).select("seed", *SEED, F.lit(False).alias("own"), F.lit(n).alias("round"), "iou"))
        grown = new.select("seed").distinct()
        still = live.join(grown, "seed", "left_anti")
        done = still if done is None else done.unionByName(still)
        if new.isEmpty():
            break
        matches = cut(matches.unionByName(new))
        live = cut(labels_of(matches.join(grown, "seed"), given, seen, low))
    else:
        done = done.unionByName(live)
    return matches, cut(done)


def active_seeds(seeds: DataFrame, matches: DataFrame) -> DataFrame:
    """(seed, active) of seeds (seed, scene, view, mask, rank): a seed is left out if one before it in its scene that is not has matched its mask.

    Only seeds that matched something decide on others. Each round settles the seeds that no
    undecided one is before.
    """
    tells = matches.filter("not own").join(seeds.select("seed", F.col("rank").alias("first")), "seed").select(F.col("seed").alias("by"), *SEED, "first")
    edges = cut(tells.join(seeds, SEED).filter("first < rank").select("seed", "by").distinct())
    state = cut(seeds.join(edges.select("seed").distinct().withColumn("waits", F.lit(True)), "seed", "left").select("seed", F.when(F.col("waits").isNull(), True).alias("active")))
    while not state.filter("active is null").isEmpty():
        asked = state.filter("active is null").select("seed").join(edges, "seed").join(state.select(F.col("seed").alias("by"), F.col("active").alias("theirs")), "by")
        told = asked.groupBy("seed").agg(F.max(F.coalesce("theirs", F.lit(False))).alias("gone"), F.max(F.col("theirs").isNull()).alias("waits"))
        verdict = F.when(F.col("gone"), False).when(~F.col("waits"), True)
        state = cut(state.join(told, "seed", "left").select("seed", F.when(F.col("active").isNotNull(), F.col("active")).otherwise(verdict).alias("active")))
    return state


def objects_of(seeds: DataFrame, labels: DataFrame) -> DataFrame:
    """(seed, object) of seeds (seed, rank) by the Gaussians (seed, scene, pid) that they take, object being the seed that founded it.

    In order of rank each seed takes all its Gaussians. If enough of them belonged to objects and
    one object holds enough of them, they go to that one, the first of equals, else to a new one.
    """
    own = labels.join(seeds.select("seed", "rank"), "seed")
    before = F.lag("seed").over(Window.partitionBy("scene", "pid").orderBy("rank", "seed"))
    taken = cut(own.withColumn("before", before).groupBy("seed", "before").agg(F.count(F.lit(1)).alias("n")))
    sizes = taken.groupBy("seed").agg(F.sum("n").alias("size"), F.count("before").alias("met"))
    first = sizes.filter("met = 0").select("seed", F.col("seed").alias("object"))
    known, left = cut(first), cut(sizes.filter("met > 0").select("seed", "size"))
    ranks = seeds.select(F.col("seed").alias("object"), F.col("rank").alias("age"))
    while not left.isEmpty():
        theirs = left.join(taken.filter("before is not null"), "seed").join(known.select(F.col("seed").alias("before"), "object"), "before", "left")
        ready = theirs.groupBy("seed").agg(F.max(F.col("object").isNull()).alias("waits")).filter("not waits").select("seed")
        held = theirs.join(ready, "seed").groupBy("seed", "size", "object").agg(F.sum("n").alias("n")).join(ranks, "object")
        most = held.groupBy("seed", "size").agg(F.sum("n").alias("claimed"), F.max(F.struct("n", (-F.col("age")).alias("age"), "object")).alias("most"))
        part = (F.col("claimed") > CLAIMED * F.col("size")) & (F.col("most.n") >= SHARED * F.col("size"))
        known = cut(known.unionByName(most.select("seed", F.when(part, F.col("most.object")).otherwise(F.col("seed")).alias("object"))))
        left = cut(left.join(known, "seed", "left_anti"))
    return known


def associated(masks: DataFrame, alphas: DataFrame, weights: DataFrame, low: DataFrame, width: int, threshold: float = 0.5, rounds: int = ROUNDS, boxes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(seeds, labels): what became of every mask (scene, view, mask, px) as a seed, and the object of each Gaussian.

    seeds has scene, view, mask, rank, state, n_matches, n_points, object, part. state is "empty"
    (no Gaussian), "alone" (matched nothing; kept for a later pass), "processed" (matched by an
    earlier seed), "new" or "part" of an earlier object. Objects are numbered in their scene in
    order of rank, and so are the parts of an object. Seeds are ranked in their scene by hash of view
    and mask. labels has scene, pid and object, of the last seed that took the Gaussian. boxes, if
    given, are those that masks come from.
    """
    masks = cut(masks.select(*SEED, "px").distinct())
    boxes = cut(bounds(masks, width) if boxes is None else boxes)
    order = Window.partitionBy("scene").orderBy(F.xxhash64("view", "mask", F.lit(7)), "view", "mask")
    seeds = cut(masks.select(*SEED).distinct().select(*SEED, F.row_number().over(order).cast("long").alias("rank")).withColumn("seed", F.monotonically_increasing_id()))
    matches, labels = matched_rounds(seeds, alphas, weights, masks, boxes, low, width, threshold, rounds)
    counts = matches.groupBy("seed").agg(F.count(F.lit(1)).alias("n_matches")).join(labels.groupBy("seed").agg(F.count(F.lit(1)).alias("n_points")), "seed", "full")
    state = active_seeds(seeds, matches.join(counts.filter("n_matches > 1").select("seed"), "seed", "left_semi"))
    told = cut(seeds.join(counts, "seed", "left").join(state, "seed"))
    good = told.filter("active and n_matches > 1 and n_points > 0")
    objects = objects_of(good, labels.join(good.select("seed"), "seed", "left_semi"))
    founded = told.join(objects, "seed", "left")
    names = founded.filter("object = seed").select("object", F.row_number().over(Window.partitionBy("scene").orderBy("rank")).cast("long").alias("number"))
    named = cut(founded.join(names, "object", "left"))
    word = F.when(~F.col("active"), "processed").when((F.col("n_matches") == 1) & F.col("n_points").isNull(), "empty").when(F.col("n_matches") == 1, "alone").when(F.col("object") == F.col("seed"), "new").when(F.col("object").isNotNull(), "part").otherwise("empty")
    part = F.row_number().over(Window.partitionBy("scene", "object", F.col("object") == F.col("seed")).orderBy("rank"))
    out = named.select(*SEED, "rank", word.alias("state"), "n_matches", F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"), F.col("number").alias("object"), F.when((F.col("object") != F.col("seed")), part).cast("long").alias("part"))
    taken = labels.join(named.filter("object is not null").select("seed", "rank", "number"), "seed").groupBy("scene", "pid").agg(F.max(F.struct("rank", "number")).alias("m")).select("scene", "pid", F.col("m.number").alias("object"))
    return out, taken
