"""Association of masks to instances, against one seed after the other."""

from __future__ import annotations

import math
import struct
from collections import Counter, defaultdict

import xxhash

from furrow.operators import association as V
from furrow.plans import point_queries as Q

WIDTH, LEVEL = 32, 0.3


def hashed(view, mask):
    """Spark's xxhash64 of two longs and 7."""
    seed = 42
    for fmt, v in (("<q", view), ("<q", mask), ("<i", 7)):
        seed = xxhash.xxh64(struct.pack(fmt, v), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def sequential(masks, alphas, weights, low, threshold):
    """One scene at a time, one seed after the other, as a person would do it."""
    pixels, alpha, gives, lows = defaultdict(set), defaultdict(lambda: defaultdict(list)), defaultdict(list), set(low)
    for s, v, m, px in masks:
        pixels[s, v, m].add(px)
    for s, v, px, pid, a in alphas:
        alpha[s, v][pid].append((px, a))
    for s, v, px, pid, w in weights:
        gives[s, v].append((px, pid, w))
    seeds_out, labels_out = {}, {}
    for scene in sorted({k[0] for k in pixels}):
        views = sorted({k[1] for k in pixels if k[0] == scene})
        order = sorted((k for k in pixels if k[0] == scene), key=lambda k: (hashed(k[1], k[2]), k[1:]))
        processed, which, found, parts = set(), {}, 0, Counter()

        def labelled(matched, seed):
            inside, whole = defaultdict(float), defaultdict(float)
            for key in matched:
                for px, pid, w in gives[scene, key[1]]:
                    whole[pid] += w
                    if px in pixels[key] and not (key == seed and (scene, pid) in lows):
                        inside[pid] += w
            return {pid for pid, c in inside.items() if c > 0 and c > whole[pid] - c}

        def matches(pids, views):
            out = []
            for v in views:
                dark = defaultdict(float)
                for pid in pids:
                    for px, a in alpha[scene, v].get(pid, ()):
                        dark[px] += math.log1p(-a)
                lit = {px for px, d in dark.items() if d < math.log(0.5)}
                if not lit:
                    continue
                u1, u2, v1, v2 = min(p % WIDTH for p in lit), max(p % WIDTH for p in lit), min(p // WIDTH for p in lit), max(p // WIDTH for p in lit)
                best, chosen = threshold, None
                for key in sorted(k for k in pixels if k[:2] == (scene, v)):
                    own = pixels[key]
                    x1, x2, y1, y2 = min(p % WIDTH for p in own), max(p % WIDTH for p in own), min(p // WIDTH for p in own), max(p // WIDTH for p in own)
                    if u1 <= x2 and x1 <= u2 and v1 <= y2 and y1 <= v2 and len(lit & own) / len(lit | own) > best:
                        best, chosen = len(lit & own) / len(lit | own), key
                if chosen:
                    out.append(chosen)
            return out

        for rank, seed in enumerate(order, 1):
            matched = [seed]
            pids = labelled(matched, seed)
            if pids:
                while True:
                    new = matches(pids, [v for v in views if v not in {k[1] for k in matched}])
                    if not new:
                        break
                    matched += new
                    pids = labelled(matched, seed)
            row = [rank, None, len(matched), len(pids), None, None]
            seeds_out[seed] = row
            if seed in processed:
                row[1] = "processed"
                continue
            if len(matched) == 1:
                row[1] = "alone" if pids else "empty"
                continue
            processed.update(matched[1:])
            if not pids:
                row[1] = "empty"
                continue
            held = Counter(which[p] for p in pids if p in which)
            most = min(held, key=lambda o: (-held[o], o)) if held else None
            if sum(held.values()) > 0.8 * len(pids) and held[most] >= 0.6 * len(pids):
                parts[most] += 1
                row[1], row[4], row[5] = "part", most, parts[most]
            else:
                found += 1
                most = found
                row[1], row[4] = "new", found
            which.update(dict.fromkeys(pids, most))
        labels_out |= {(scene, p): o for p, o in which.items()}
    return seeds_out, labels_out


def compared(masks, alphas, weights, low, threshold):
    seeds, labels = V.associated(masks, alphas, weights, low, WIDTH, threshold)
    rows = lambda df, *names: [tuple(r) for r in df.select(*names).collect()]
    want = sequential(rows(masks, "scene", "view", "mask", "px"), rows(alphas, "scene", "view", "px", "pid", "alpha"), rows(weights, "scene", "view", "px", "pid", "w"), rows(low, "scene", "pid"), threshold)
    got = {tuple(r)[:3]: list(r)[3:] for r in seeds.collect()}
    assert got == want[0]
    assert {(r["scene"], r["pid"]): r["object"] for r in labels.collect()} == want[1]
    return got


def test_instance_rounds(spark, sf_dir):
    inputs = Q.instance_inputs(spark, sf_dir)
    got = compared(*inputs, LEVEL)
    assert {"new", "part", "processed", "alone"} <= {r[1] for r in got.values()} and max(r[2] for r in got.values()) > 2
    want = {tuple(r)[:3]: list(r)[3:] for r in Q.instance_rounds(spark, sf_dir).collect()}
    assert got == want


def test_parts_and_chains(spark):
    """Masks that overlap, so that seeds take Gaussians from each other in long chains."""
    weights, alphas, masks = [], [], []
    for view in range(3):
        for pid in range(40):
            px = (pid * 3 + view) % 40 if pid % 5 else pid
            weights.append((0, view, px, pid, 0.9 - 0.01 * (pid % 7)))
            alphas.append((0, view, px, pid, 0.9))
        for mask in range(12):
            masks += [(0, view, mask, px) for px in range(mask * 3, min(40, mask * 3 + 5 + (mask * view) % 4))]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = compared(
        frame(masks, "scene long, view long, mask long, px long"), frame(alphas, "scene long, view long, px long, pid long, alpha double"),
        frame(weights, "scene long, view long, px long, pid long, w double"), frame([(0, 3), (0, 8)], "scene long, pid long"), 0.2)
    assert len({r[1] for r in got.values()}) >= 3
