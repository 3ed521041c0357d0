"""Palettes: clustering, samples of images, and the roles held against plain versions on the same clusters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintlake.functions import colour
from tintlake.operators import clusters, palettes, pixels, roles, tables
from tintlake.schemas import ROLES

SKY, ORANGE, NAVY, PLUM, CREAM, MOSS = (148, 188, 222), (231, 108, 34), (22, 34, 74), (96, 38, 110), (238, 226, 196), (78, 112, 58)


def poster(spark, bands, width=12, height=60, key=1):
    """Pixels of a poster of horizontal bands ((r, g, b), share)."""
    rows, y = [], 0
    for (r, g, b), share in bands:
        n = round(share * height)
        rows += [(key, y + i, x, r, g, b) for i in range(n) for x in range(width)]
        y += n
    return spark.createDataFrame(rows, "poster long, y int, x int, r int, g int, b int")


def near(code, rgb, most=12):
    return max(abs(int(code[i : i + 2], 16) - c) for i, c in zip((1, 3, 5), rgb)) <= most


def image(spark, a, mode=16, n=3):
    h, w = a.shape[:2]
    return spark.createDataFrame([(1, ("f", h, w, n, mode, bytearray(a.astype(np.uint8).tobytes()))), (2, ("bad", -1, -1, -1, -1, bytearray()))], "poster long, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>")


# ---------------------------------------------------------------- samples


def test_pixels_of_images(spark):
    a = np.zeros((4, 4, 3))
    a[:2, :, 0], a[2:, :, 2] = 255, 255  # blue, then red, as BGR
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in pixels.from_images(image(spark, a), 2, 2).collect()}
    assert got == {(0, 0): (0, 0, 255), (0, 1): (0, 0, 255), (1, 0): (255, 0, 0), (1, 1): (255, 0, 0)}
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (7, 5, 4))
    want = {}
    for y in range(3):
        for x in range(2):
            cell = [a[i, j] for i in range(7) for j in range(5) if i * 3 // 7 == y and j * 2 // 5 == x]
            want[y, x] = tuple(int(np.rint(np.mean([c[k] * c[3] / 255 + 255 * (1 - c[3] / 255) for c in cell]))) for k in (2, 1, 0))
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in pixels.from_images(image(spark, a, 24, 4), 2, 3).collect()} == want
    clear = pixels.from_images(image(spark, a, 24, 4), 50, 50, clear=True).collect()
    assert len(clear) == 35 and all((r.b, r.g, r.r, r.alpha) == tuple(a[r.y, r.x]) for r in clear)
    grey = pixels.from_images(image(spark, a[..., :1], 0, 1), 5, 7).collect()
    assert all(r.r == r.g == r.b == a[r.y, r.x, 0] for r in grey)


def test_triangle_sample(spark):
    flat = np.full((30, 20, 3), 77)
    assert {(r.r, r.g, r.b) for r in pixels.triangle(image(spark, flat), 6, 9).collect()} == {(77, 77, 77)}
    ramp = np.repeat(np.arange(40)[None, :, None] * 6, 12, axis=0).repeat(3, axis=2)
    got = {(r.y, r.x): r.r for r in pixels.triangle(image(spark, ramp), 10, 4).collect()}
    assert all(abs(got[0, x] - 6 * (4 * x + 1.5)) <= 1 for x in range(1, 9))  # a linear filter keeps a ramp


def test_samples_bound_a_poster(spark):
    big = spark.range(0, 50_000).select(F.lit(1).alias("poster"), (F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"), *[(F.col("id") % m).cast("int").alias(c) for c, m in (("r", 7), ("g", 100), ("b", 200))])
    small = big.where("y < 8").withColumn("poster", F.lit(2))
    got = pixels.sampled(big.unionByName(small), 60, 90)
    assert got.where("poster = 1").count() == 900 and got.where("poster = 2").exceptAll(small).count() == 0


# ---------------------------------------------------------------- clusters


def test_k_means_on_blocks_is_that_of_each_poster():
    rng = np.random.default_rng(5)
    sizes = [1, 40, 7, 300]
    points, on = np.zeros((4, 300, 3)), np.zeros((4, 300), bool)
    for i, n in enumerate(sizes):
        points[i, :n], on[i, :n] = rng.random((n, 3)), True
    k = np.minimum(6, clusters.distinct(points, on))
    assert k.tolist() == [1, 6, 6, 6]
    both = clusters.k_means(points, on, k, 30)
    for i, n in enumerate(sizes):
        alone = clusters.k_means(points[i : i + 1, :n], on[i : i + 1, :n], k[i : i + 1], 30)
        assert (both[i, :n] == alone[0]).all()
        for j in set(alone[0].tolist()):  # each pixel is with the nearest mean
            means = {c: points[i, :n][alone[0] == c].mean(0) for c in set(alone[0].tolist())}
            assert all(min(means, key=lambda c: np.linalg.norm(p - means[c])) == j for p in points[i, :n][alone[0] == j])


def test_close_clusters_merge():
    rng = np.random.default_rng(8)
    n, centre = rng.integers(1, 50, (20, 9)), rng.random((20, 9, 3)) * [1, 0.3, 0.3]
    centre[:, 0], centre[:, 3] = [0.1, 0.01, 0.0], [0.15, 0.0, 0.02]
    into = clusters.merged(n, centre * n[..., None], clusters.Clustering(merge=0.12))
    for i in range(20):
        groups = {}
        for j, g in enumerate(into[i]):
            groups.setdefault(g, []).append(j)
        means = [np.average(centre[i, js], axis=0, weights=n[i, js]) for js in groups.values()]
        assert into[i, 0] == into[i, 3] and all(g == min(js) or len(js) > 1 for g, js in groups.items())
        assert min((np.linalg.norm(a - b) for x, a in enumerate(means) for b in means[:x]), default=1) >= 0.12
    far = clusters.merged(np.ones((1, 3), int), np.array([[[0.2, 0.3, 0], [0.5, 0.3, 0], [0.8, 0.3, 0.0]]]), clusters.Clustering())
    assert far.tolist() == [[0, 1, 2]]


def test_regions():
    grid = np.array([[1, 1, 2, 1], [2, 1, 2, 1], [2, 2, 2, 1], [1, 2, 1, 1]])
    got = clusters.regions(grid)
    assert len({*got[grid == 1].tolist()}) == 3 and len({*got[grid == 2].tolist()}) == 1
    assert got[0, 3] == got[3, 2] == got[3, 3] != got[0, 0]
    snake = np.zeros((31, 31), int)
    snake[1::4, :-1], snake[3::4, 1:] = 1, 1
    assert len(set(clusters.regions(snake)[snake == 1].tolist())) == 15


def test_small_vivid_spots_are_accents(spark):
    p = poster(spark, [((120, 120, 122), 0.9), ((118, 119, 121), 0.1)], 40, 50).where("NOT (x < 4 AND y < 3)")
    spot = spark.createDataFrame([(1, y, x, 250, 20, 30) for y in range(3) for x in range(4)], p.schema)
    x = clusters.cluster(p.unionByName(spot), clusters.Clustering(k=1)).collect()
    assert {r.accent for r in x if r.r == 250} == {True} and {r.accent for r in x if r.r < 200} == {False}
    assert len({r.label for r in x if r.r == 250} & {r.label for r in x if r.r < 200}) == 0


def test_labels_come_with_their_grid(spark):
    p = poster(spark, [(SKY, 0.5), (NAVY, 0.5)], 5, 6).where("NOT (y = 5 AND x > 2)")
    x = {(r.y, r.x): r for r in clusters.cluster(p).collect()}
    for (a, b), r in x.items():
        assert (r.h, r.w) == (6, 5)
        assert r.right == (x[a, b + 1].label if (a, b + 1) in x else -1) and r.below == (x[a + 1, b].label if (a + 1, b) in x else -1)
    want = {tuple(r) for r in pixels.on_grid(clusters.cluster(p).select("poster", "y", "x", "label")).select("y", "x", "right", "below", "h", "w").collect()}
    assert want == {(a, b, r.right, r.below, r.h, r.w) for (a, b), r in x.items()}
    trimmed = clusters.cluster(poster(spark, [(SKY, 1.0)], 40, 60), clusters.V3).collect()
    assert {(r.y, r.x) for r in trimmed if r.label < 0} == {(y, x) for y in range(60) for x in range(40) if y in (0, 59) or x in (0, 39)}


# ---------------------------------------------------------------- first and second version


def test_palettes_of_bands(spark):
    p = poster(spark, [(SKY, 0.6), (ORANGE, 0.25), (NAVY, 0.15)])
    v1 = palettes.palette_v1(clusters.cluster(p, clusters.V1, "cielab")).first()
    assert near(v1.primary_hex, SKY) and v1.primary_ratio == 0.6 and near(v1.secondary_hex, ORANGE) and near(v1.tertiary_hex, NAVY)
    x = clusters.cluster(p)
    v2 = palettes.palette_v2(x).first()
    assert near(v2.primary_hex, ORANGE)  # identity beats the larger sky
    assert palettes.review_flags(palettes.palette_v2(x), x).first().flags == []


def test_flat_and_grey_posters(spark):
    flat = poster(spark, [((200, 30, 30), 1.0)])
    v1 = palettes.palette_v1(clusters.cluster(flat, clusters.V1, "cielab")).first()
    assert v1.primary_hex == v1.secondary_hex == v1.tertiary_hex == "#C81E1E" and v1.tertiary_ratio == 1.0
    v2 = palettes.palette_v2(clusters.cluster(flat)).first()
    assert v2.primary_hex == v2.tertiary_hex
    grey = palettes.palette_v2(clusters.cluster(poster(spark, [((30, 30, 30), 0.5), ((128, 128, 128), 0.3), ((230, 230, 230), 0.2)]))).first()
    assert all(len({grey[f"{s}_hex"][i : i + 2] for i in (1, 3, 5)}) == 1 for s in ("primary", "secondary", "tertiary"))


# ---------------------------------------------------------------- third version: properties of its results


def oklab_of(rgb):
    lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb]
    lms = [math.copysign(abs(v) ** (1 / 3), v) for v in (sum(m * x for m, x in zip(row, lin)) for row in colour.RGB_TO_LMS)]
    return [sum(m * x for m, x in zip(row, lms)) for row in colour.LMS_TO_LAB]


def matrix_of_limits(colours, hues=True):
    """[i, j]: which of the three limits, from strict to lax, is the first that keeps colours i and j apart; 3 for none."""
    lab = np.array([[c["ll"], c["la"], c["lb"]] for c in colours])
    d = np.linalg.norm(lab[:, None] - lab[None], axis=2)
    chroma, hue = np.hypot(lab[:, 1], lab[:, 2]), np.degrees(np.arctan2(lab[:, 2], lab[:, 1]))
    turn = np.abs((hue[:, None] - hue[None] + 180) % 360 - 180)
    kin = hues & (np.minimum.outer(chroma, chroma) >= 0.05) & (turn < 20)
    fails = [(d < 0.10 * s) | (kin & (d < 0.18 * s)) for s in (1.0, 0.6, 0.35)]
    return np.sum(fails, axis=0)  # a colour that is too close by a lax limit is so by the stricter ones


def check_ladder(clusters_, ladder):
    """No cluster that was left could have taken a slot: none is apart by a stricter limit, or as much and better."""
    large = [c for c in clusters_ if c["share"] >= 0.01] or clusters_
    at = {c["hex"]: i for i, c in enumerate(large)}
    limits, taken = matrix_of_limits(large), [at[h] for h in ladder]
    assert len(set(taken)) == len(taken) <= 8
    blends = (0.92, 0.9, 0.8, 0.72, 0.62, 0.6, 0.6, 0.6)
    for slot in range(min(8, len(large))):
        before = taken[:slot]
        worst = limits[:, before].max(axis=1, initial=0)
        rest = [i for i in range(len(large)) if i not in before]
        if slot >= len(taken):
            assert slot >= 5 and all(worst[i] == 3 for i in rest)
            break
        rank = lambda i: (-worst[i], round(blends[slot] * large[i]["dominance"] + (1 - blends[slot]) * large[i]["vividness"], 12), large[i]["share"], large[i]["hex"])  # noqa: B023, E731
        assert rank(taken[slot]) == max(map(rank, rest))


def check_roles(clusters_, ladder, logo, colours, sources):
    """Each role's colour is the best admissible one, given those of the roles before it."""
    by_share = sorted(clusters_, key=lambda c: (-c["share"], c["label"]))
    rungs = [next(c for c in by_share if c["hex"] == h) for h in ladder]
    offered = rungs + by_share + logo
    limits, plain = matrix_of_limits(offered + colours), matrix_of_limits(offered + colours, hues=False)
    first_cluster, first_logo, first_pick = len(rungs), len(rungs) + len(by_share), len(offered)
    same = lambda p, q: p["hex"] == q["hex"] and abs(p["ll"] - q["ll"]) < 1e-9
    used, shown = set(), set()
    assert sources[0] == "base"
    for k, (name, pick, source) in enumerate(zip(ROLES[1:], colours[1:], sources[1:]), 1):
        before = slice(first_pick, first_pick + k)
        worst, apart = limits[:, before].max(axis=1), plain[:, before].max(axis=1) == 0
        marks = [j for j in range(len(logo)) if j not in shown and apart[first_logo + j]]
        free = [i for i in range(len(rungs)) if i not in used and worst[i] < 3]
        if source == "logo":
            assert name.startswith("identity") and same(pick, logo[marks[0]])
            shown.add(marks[0])
            continue
        assert not (name.startswith("identity") and marks), "a colour of the logo was passed over"
        if source == "derived":
            lighter = pick["ll"] - colours[0]["ll"]
            assert not free and all(worst[first_cluster + i] == 3 for i in range(len(by_share)))
            assert (lighter > 0) == (colours[0]["ll"] < 0.5) and (pick["la"], pick["lb"]) == (colours[0]["la"], colours[0]["lb"])
            assert abs(abs(lighter) - (0.18 + 0.06 * k)) < 1e-9 or pick["ll"] in (0.02, 0.98)
            continue
        assert source == "artwork"
        if not free:
            assert same(pick, by_share[min(i for i in range(len(by_share)) if worst[first_cluster + i] < 3)])
            continue
        own = next(i for i in free if same(pick, rungs[i]))
        used.add(own)
        strict = [i for i in free if worst[i] == 0]
        if name == "accent" and strict:
            lively = {i: 0.65 * rungs[i]["dominance"] + 0.35 * (0.6 * min(rungs[i]["chroma"] / 0.2, 1) + 0.4 * rungs[i]["distinct"]) for i in strict[:2]}
            assert lively[own] == max(lively.values())
        else:
            dull = {i: name != "highlight1" and name != "highlight2" and rungs[i]["chroma"] < 0.035 for i in free}
            assert (worst[own], dull[own], own) == min((worst[i], dull[i], i) for i in free)


def check_features(rows, clusters_):
    """Shares sum to one; dominance and vividness are what their parts, counted on the grid of labels, say."""
    grid = np.full((rows[0].h, rows[0].w), -1)
    for r in rows:
        grid[r.y, r.x] = r.label
    assert sum(c["share"] for c in clusters_) == pytest.approx(1)
    n, most = (grid >= 0).sum(), max(c["share"] for c in clusters_)
    ys, xs = np.indices(grid.shape)
    cell = (((ys + 1) * 6 - 1) // grid.shape[0]) * 4 + ((xs + 1) * 4 - 1) // grid.shape[1]
    for c in clusters_:
        own = grid == c["label"]
        assert c["share"] == own.sum() / n
        here, all_ = np.bincount(cell[own], minlength=24), np.bincount(cell.ravel(), minlength=24)
        spatial = ((here >= 0.08 * all_) & (all_ > 0)).sum() / 24
        inner = (own[:, 1:] & own[:, :-1]).sum() + (own[1:] & own[:-1]).sum()
        steady = 0.55 * math.sqrt(c["share"] / most) + 0.25 * spatial + 0.10 * inner / (2 * own.sum())
        assert 0 < (c["dominance"] - steady) / 0.10 <= 1 + 1e-9  # the rest is the largest region's share
        assert 0.6 * min(c["chroma"] / 0.2, 1) - 1e-9 <= c["vividness"] <= 0.6 * min(c["chroma"] / 0.2, 1) + 0.4 + 1e-9


def test_roles_are_the_best_admissible_ones(spark):
    r, frames = random.Random(21), []
    for key in range(1, 15):
        palette_ = [tuple(r.randrange(256) for _ in range(3)) for _ in range(r.choice((1, 2, 3, 6, 9)))]
        if key % 4 == 0:
            palette_ = [tuple(min(255, c + d) for c in palette_[0]) for d in (0, 25, 50)]
        h, w, blocks = r.randint(12, 40), r.randint(9, 25), [(r.randrange(40), r.randrange(25), r.randrange(3, 18), r.choice(palette_)) for _ in range(40)]
        for y in range(h):
            for x in range(w):
                c = next((c for a, b, n, c in blocks if a <= y < a + n and b <= x < b + n), palette_[0])
                frames.append((key, y, x, *[max(0, min(255, v + r.randint(-2, 2))) for v in c]))
    x = clusters.cluster(spark.createDataFrame(frames, "poster long, y int, x int, r int, g int, b int"), clusters.V3)
    as_colour = lambda lab, source: {"hex": "#", **dict(zip(("ll", "la", "lb"), lab)), "chroma": math.hypot(lab[1], lab[2]), "hue": math.degrees(math.atan2(lab[2], lab[1])) % 360, "source": source}
    logos = {k: [as_colour(oklab_of(c), "logo") for c in ((210, 30, 60), (30, 160, 90))[: k % 3]] for k in range(1, 15)}
    own = "poster long, logo array<struct<hex: string, ll: double, la: double, lb: double, chroma: double, hue: double, source: string>>"
    found = roles.palette_v3(x, spark.createDataFrame([(k, [tuple(c.values()) for c in v]) for k, v in logos.items() if v], own), detail=True).collect()
    rows, described = {}, {}
    for row in x.collect():
        rows.setdefault(row.poster, []).append(row)
    for c in roles.described(x).collect():
        described.setdefault(c.poster, []).append(c.asDict())
    for p in found:
        check_features(rows[p.poster], described[p.poster])
        check_ladder(described[p.poster], p.ladder)
        check_roles(described[p.poster], p.ladder, logos[p.poster], [c.asDict() for c in p.colours], p.sources)
    assert len(found) == 14 and {s for p in found for s in p.sources} == {"base", "logo", "artwork", "derived"}


def test_ladder_by_sql_is_that_of_the_columns(spark):
    """The table function gives the ladder of the DataFrame form, with the default rules and others, and takes no unknown one."""
    art = [(SKY, 0.35), (NAVY, 0.22), (ORANGE, 0.16), (CREAM, 0.12), (PLUM, 0.09), (MOSS, 0.06)]
    shades = [(tuple(min(255, c + 14 * k) for c in NAVY), 0.1) for k in range(10)]
    x = poster(spark, art, 20, 40).unionByName(poster(spark, shades, 20, 40).withColumn("poster", F.col("poster") + 1)).unionByName(poster(spark, art[:2], 20, 40).withColumn("poster", F.col("poster") + 2))
    x = clusters.cluster(x, clusters.V3)
    for rules in ("{}", '{"slots": [1.0, 0.3, 0.3, 0.3], "gap": 0.25, "filled": 2}'):
        want = {p.poster: p.ladder for p in roles.palette_v3(x, how=roles.Rules.from_json(rules)).collect()}
        rows = tables.ladder_rows(roles.described(x), rules).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.poster, r.slot)):
            got.setdefault(r.poster, []).append(r.hex)
            assert len(got[r.poster]) == r.slot and 0 <= r.level <= 3
        assert got == want and len(want) == 3
    assert roles.Rules.from_json(spark.sql("SELECT role_rules() AS r").first().r) == roles.RULES
    with pytest.raises(Exception, match="no slotz"):
        tables.ladder_rows(roles.described(x), '{"slotz": 1}').collect()


def test_base_of_known_posters(spark):
    """Both corners of one colour, related corners, unrelated ones with and without the heavier in a corner."""
    def rows(key, top):
        return [(key, y, x, *(top(x) if y < 6 else MOSS)) for y in range(30) for x in range(20)]

    deep, pale = (40, 60, 130), (60, 80, 150)  # near each other
    posters = {1: lambda x: SKY if x < 7 or x >= 13 else PLUM, 2: lambda x: deep if x < 10 else pale, 3: lambda x: SKY if x < 12 else ORANGE, 4: lambda x: SKY if x < 4 else CREAM if x < 16 else ORANGE}
    frame = spark.createDataFrame([r for k, f in posters.items() for r in rows(k, f)], "poster long, y int, x int, r int, g int, b int")
    got = {p.poster: p.base for p in roles.palette_v3(clusters.cluster(frame, clusters.V3)).collect()}
    assert near(got[1], SKY) and near(got[3], SKY) and near(got[4], CREAM)
    assert all(min(a, b) - 3 <= int(got[2][i : i + 2], 16) <= max(a, b) + 3 for i, a, b in zip((1, 3, 5), deep, pale)) and not near(got[2], deep, 4) and not near(got[2], pale, 4)


def test_six_roles(spark):
    art = [(SKY, 0.35), (NAVY, 0.22), (ORANGE, 0.16), (CREAM, 0.12), (PLUM, 0.09), (MOSS, 0.06)]
    three = roles.palette_v3(clusters.cluster(poster(spark, art, 40, 100), clusters.V3)).first()
    assert near(three.base, SKY) and len({three[r] for r in ROLES}) == 6 and three.sources == ["base"] + ["artwork"] * 5
    bare = roles.palette_v3(clusters.cluster(poster(spark, [(SKY, 0.6), (ORANGE, 0.25), (NAVY, 0.15)]), clusters.V3)).first()
    assert near(bare.base, SKY) and len({bare[r] for r in ROLES}) == 6 and bare.sources[-1] == "derived"


def test_logo_colours_that_the_poster_has(spark):
    p = poster(spark, [(SKY, 0.5), (ORANGE, 0.45), (NAVY, 0.05)], 40, 60)

    def logo(*parts):
        rows, y = [], 0
        for (r, g, b), alpha, n in parts:
            rows += [(1, y + i, x, r, g, b, alpha) for i in range(n) for x in range(10)]
            y += n
        return spark.createDataFrame(rows, "poster long, y int, x int, r int, g int, b int, alpha int")

    def colours(*parts):
        found = roles.logo_colours(clusters.cluster(roles.solid(logo(*parts)), clusters.LOGO), p).first()
        return [] if found is None else [c.hex for c in found.logo]

    both = colours((ORANGE, 255, 6), (NAVY, 255, 3), ((255, 255, 255), 255, 9), (PLUM, 90, 9))
    assert len(both) == 2 and near(both[0], ORANGE) and near(both[1], NAVY)  # white and what is clear don't count
    assert len(colours((ORANGE, 255, 6), (PLUM, 255, 6))) == 1  # the poster has no plum
    assert colours(((255, 255, 255), 255, 6), ((10, 10, 10), 255, 6)) == []
    assert colours((ORANGE, 255, 1)) == []  # too few pixels
    assert len(colours((ORANGE, 255, 5), ((240, 116, 40), 255, 5))) == 1  # near duplicates are one
    found = roles.logo_colours(clusters.cluster(roles.solid(logo((ORANGE, 255, 6))), clusters.LOGO), p)
    v3 = roles.palette_v3(clusters.cluster(p, clusters.V3), found).first()
    assert near(v3.identity1, ORANGE) and v3.sources[1] == "logo" and len(v3.logo_colours) == 1


def test_metallic_logo(spark):
    p = poster(spark, [((150, 150, 152), 0.5), ((90, 90, 92), 0.5)], 40, 60)
    shine = spark.createDataFrame([(1, y, x, *[int(60 + 180 * ((y * 10 + x) % 50) / 49)] * 3, 255) for y in range(20) for x in range(10)], "poster long, y int, x int, r int, g int, b int, alpha int")
    x = clusters.cluster(roles.solid(shine), clusters.Clustering(k=1, merge=0.08, accents=0))
    assert len(roles.logo_colours(x, p).first().logo) == 1


def test_role_weights():
    assert set(roles.ROLE_WEIGHTS) == set(ROLES) and all(lo < hi for lo, hi in roles.ROLE_WEIGHTS.values())


@pytest.mark.parametrize("hot", [False, True])
def test_many_posters_at_once(spark, hot):
    """Blocks of posters of different sizes give what each gives alone."""
    rng = random.Random(3)
    rows = [(k, i // 10, i % 10, *[rng.randrange(256) for _ in range(3)]) for k in range(60) for i in range(900 if hot and k == 7 else rng.randint(1, 60))]
    schema = "poster long, y int, x int, r int, g int, b int"
    together = {tuple(r) for r in clusters.cluster(spark.createDataFrame(rows, schema)).collect()}
    alone = {tuple(r) for k in (3, 7) for r in clusters.cluster(spark.createDataFrame([r for r in rows if r[0] == k], schema)).collect()}
    assert alone <= together and len(together) == len(rows)
