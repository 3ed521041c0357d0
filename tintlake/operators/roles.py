"""The third palette version: six roles from the clusters of an artwork and the colours of its logo.

A poster's at most 16 clusters are one row, counted by ``summaries``; what describes them, the slots of the ladder and the
roles are folds over such short arrays, expressions without a UDF, so nothing is shuffled after that.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..plans.cut import materialise
from ..schemas import ROLES
from . import pixels as px
from . import summaries
from .pixels import LAB

# How much of generated artwork each role takes, at least and at most.
ROLE_WEIGHTS = {"base": (0.40, 0.50), "identity1": (0.25, 0.30), "identity2": (0.10, 0.20), "highlight1": (0.10, 0.20), "highlight2": (0.10, 0.20), "accent": (0.03, 0.08)}
# What dominance and vividness are made of.
DOMINANCE = {"share": 0.55, "spatial": 0.25, "coherence": 0.10, "region": 0.10}
VIVIDNESS = {"chroma": 0.6, "contrast": 0.4}
FULL = {"chroma": 0.20, "contrast": 0.40, "distinct": 0.40}
# How close corners of the top band are related.
RELATED = 0.12
# What a logo's cluster needs to be one of its colours.
LOGO = {"share": 0.06, "chroma": 0.035, "dark": 0.30, "slope": 0.25, "spread": 0.12, "light": (0.45, 0.92), "metal_share": 0.25, "solid": 200, "pixels": 20, "samples": 4000, "near": 0.10, "present": 0.004}


# The defaults.
@dataclass(frozen=True)
class Rules:
    """How the ladder and the roles are chosen.

    ``slots``: the weight of dominance by slot of the ladder; ``least_share`` of a ladder colour; ``filled``: slots that
    are filled even with colours too close. Two colours are too close below ``gap``, or below ``hue_gap`` with both of
    ``hue_chroma`` and hues within ``hue`` degrees; limits are relaxed by ``relaxed``. Below ``neutral`` chroma a colour
    has no hue of its own. ``accents``: candidates of the accent, ``accent_vivid``: what their liveliness weighs.
    """

    slots: tuple[float, ...] = (0.92, 0.9, 0.8, 0.72, 0.62, 0.6, 0.6, 0.6)
    least_share: float = 0.01
    filled: int = 5
    gap: float = 0.10
    hue_gap: float = 0.18
    hue: float = 20.0
    hue_chroma: float = 0.05
    relaxed: tuple[float, float, float] = (1.0, 0.6, 0.35)
    neutral: float = 0.035
    accents: int = 2
    accent_vivid: float = 0.35

    @staticmethod
    def from_json(text: str | None) -> Rules:
        """Rules that differ from the defaults in what a JSON object says."""
        given = json.loads(text or "{}")
        unknown = set(given) - {f.name for f in fields(Rules)}
        if unknown:
            raise ValueError(f"rules have no {', '.join(sorted(unknown))}")
        return Rules(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


RULES = Rules()


def _full(x: Column, most: float) -> Column:
    return F.least(x / most, F.lit(1.0))


_COLOUR = ("hex", *LAB, "chroma", "hue")
_DESCRIBED = ("label", "n", *_COLOUR, "share", "dominance", "vividness", "distinct")


def _true_colour(lightness: Column, a: Column, b: Column) -> dict[str, Column]:
    """_COLOUR of a colour that is stretched to its members' mean chroma."""
    return {"hex": colour.to_hex(*colour.oklab_to_rgb(lightness, a, b)), "ll": lightness, "la": a, "lb": b, "chroma": colour.chroma(a, b), "hue": colour.hue(a, b)}


def _described(labelled: DataFrame) -> DataFrame:
    """Posters with ``d``: their artworks' clusters as structs of _DESCRIBED and ``y``, what was counted, the largest first."""
    x = summaries.of(labelled)
    x = x.withColumn("d", F.transform(F.filter("clusters", lambda y: y.label >= 0), lambda y: F.struct(y.alias("y"), F.struct(*[v.alias(k) for k, v in _true_colour(y.ll, y.tla, y.tlb).items()]).alias("c"))))
    x = x.withColumn("most", F.array_max(F.transform("d", lambda z: z.y.share)))
    w = DOMINANCE

    def whole(z: Column) -> Column:
        y = z.y
        found = {k: z.c[k] for k in _COLOUR} | {"label": y.label, "n": y.n, "share": y.share, "distinct": _full(y.true_distinct, FULL["distinct"])}
        found["dominance"] = w["share"] * F.sqrt(y.share / F.col("most")) + w["spatial"] * y.spatial + w["coherence"] * y.same / (2 * y.n) + w["region"] * y.region_share
        found["vividness"] = VIVIDNESS["chroma"] * _full(z.c.chroma, FULL["chroma"]) + VIVIDNESS["contrast"] * _full(y.true_contrast, FULL["contrast"])
        return F.struct(F.struct(*[found[k].alias(k) for k in _DESCRIBED]).alias("c"), y.alias("y"))

    ranked = F.array_sort(F.transform(F.transform("d", whole), lambda z: F.struct((-z.c.share).alias("s"), z.c.label.alias("l"), z.alias("z"))))
    return x.withColumn("d", F.transform(ranked, lambda z: z.z)).drop("most", "clusters")


def described(labelled: DataFrame) -> DataFrame:
    """One row per poster and cluster of an artwork: its colour, share, dominance, vividness and distinctness."""
    return _described(labelled).select("poster", F.inline(F.transform("d", lambda z: z.c)))


def _level(p: Column, q: Column, how: Rules = RULES) -> Column:
    """The first of the relaxed limits by which two colours aren't too close; 3 if none."""
    kin = (F.least(p.chroma, q.chroma) >= how.hue_chroma) & (colour.hue_gap(p.hue, q.hue) < how.hue)
    measured = F.array(F.struct(colour.distance([p[c] for c in LAB], [q[c] for c in LAB]).alias("d"), kin.alias("kin")))
    near = lambda z, s: (z.d < how.gap * s) | (z.kin & (z.d < how.hue_gap * s))
    return F.get(F.transform(measured, lambda z: F.when(~near(z, how.relaxed[0]), 0).when(~near(z, how.relaxed[1]), 1).when(~near(z, how.relaxed[2]), 2).otherwise(3)), 0)


def _worst(p: Column, others: Column, how: Rules = RULES) -> Column:
    return F.coalesce(F.array_max(F.transform(others, lambda q: _level(p, q, how))), F.lit(0))


def _ladder(c: Column, how: Rules) -> Column:
    """The colours of ``c`` that make the ladder, in order of its slots.

    Each slot takes the best by a blend of dominance and vividness, then share and hex, of those that keep away from
    the ones before by the strictest limit that any meets; colours too close by all limits fill the first slots only.
    """
    pool = F.when(F.exists(c, lambda y: y.share >= how.least_share), F.filter(c, lambda y: y.share >= how.least_share)).otherwise(c)

    def slot(acc: Column, w: Column) -> Column:
        left = F.filter(pool, lambda y: ~F.exists(acc, lambda p: p.label == y.label))
        ranked = F.transform(left, lambda y: F.struct((-_worst(y, acc, how)).alias("l"), (w * y.dominance + (1 - w) * y.vividness).alias("s"), y.share.alias("share"), y.hex.alias("hex"), y.alias("y")))
        best = F.array(F.array_max(ranked))
        taken = F.filter(best, lambda b: b.isNotNull() & ((b.l > -3) | (F.size(acc) < how.filled)))
        return F.concat(acc, F.transform(taken, lambda b: b.y))

    return F.aggregate(F.array(*[F.lit(w) for w in how.slots]), F.filter(c, lambda y: F.lit(False)), slot)


def _with_base(x: DataFrame) -> DataFrame:
    """Posters of ``_described`` with ``base``: the colour of the top band, a struct as the roles have.

    If the corners' leading clusters are the same or related, they are blended, else the one that weighs most in the
    band leads, corners counting double. The colour is that of their pixels in the band; where the band has none, that
    of the poster's largest cluster.
    """
    lead = lambda by: F.array_max(F.transform(F.filter("d", lambda z: z.y[by] > 0), lambda z: F.struct(z.y[by].alias("n"), (-z.c.label).alias("l"), F.struct(*[z.c[k].alias(k) for k in ("label", *LAB)]).alias("c")))).c
    x = x.withColumns({"a": lead("left"), "b": lead("right"), "top": lead("weight"), "largest": lead("n")})
    related = F.col("a").isNotNull() & F.col("b").isNotNull() & (colour.distance([F.col(f"a.{c}") for c in LAB], [F.col(f"b.{c}") for c in LAB]) < RELATED)
    chosen = F.when(related, F.array("a.label", "b.label")).when(F.col("top").isNotNull(), F.array("top.label")).otherwise(F.array("largest.label"))
    x = x.withColumns({"bare": F.col("top").isNull(), "chosen": chosen})
    x = x.withColumn("chosen", F.filter("d", lambda z: F.array_contains(F.col("chosen"), z.c.label)))
    sum_of = lambda of: F.aggregate("chosen", F.lit(0.0), lambda acc, z: acc + of(z))
    n = sum_of(lambda z: F.when(F.col("bare"), 1).otherwise(z.y.m))
    means = {c: sum_of(lambda z, c=c, s=s: F.when(F.col("bare"), z.c[c]).otherwise(z.y[s])) / n for c, s in zip((*LAB, "chroma"), ("sll", "sla", "slb", "sc"))}
    x = x.withColumn("mean", F.struct(*[v.alias(k) for k, v in means.items()]))
    own = colour.chroma(F.col("mean.la"), F.col("mean.lb"))
    x = x.withColumn("scale", F.when(own > 1e-6, F.col("mean.chroma") / own).otherwise(1.0))
    base = _true_colour(F.col("mean.ll"), F.col("mean.la") * F.col("scale"), F.col("mean.lb") * F.col("scale"))
    return x.withColumn("base", F.struct(*[v.alias(k) for k, v in base.items()], F.lit("base").alias("source"))).drop("a", "b", "top", "largest", "bare", "chosen", "mean", "scale")


def logo_colours(labelled: DataFrame, poster_pixels: DataFrame) -> DataFrame:
    """(poster, logo): at most two colours of a logo, best first, that its poster has, from the logo's clustered pixels.

    A cluster is a logo colour if it is large enough and has chroma, more so where it is dark, or is metallic: of
    middling, strongly varied lightness. poster_pixels: the poster's (poster, r, g, b).
    """
    f = LOGO
    g = summaries.of(labelled).select("poster", F.transform(F.filter("clusters", lambda y: y.label >= 0), lambda y: F.struct(y.alias("y"), F.struct(*[v.alias(k) for k, v in _true_colour(y.ll, y.tla, y.tlb).items()], F.lit("logo").alias("source")).alias("c"))).alias("q"))
    coloured = lambda z: z.c.chroma >= f["chroma"] + F.greatest(F.lit(0.0), f["dark"] - z.y.ll) * f["slope"]
    metallic = lambda z: (z.y.spread >= f["spread"]) & z.y.ll.between(*f["light"]) & (z.y.share >= f["metal_share"])
    score = lambda z: 0.6 * F.sqrt(z.y.share) + 0.4 * _full(z.c.chroma, FULL["chroma"])
    fit = F.filter("q", lambda z: (z.y.share >= f["share"]) & (coloured(z) | metallic(z)))
    g = g.select("poster", F.array_sort(F.transform(fit, lambda z: F.struct((-score(z)).alias("s"), z.c.hex.alias("hex"), z.c.alias("c")))).alias("q"))  # six at most
    two = F.aggregate("q", F.transform(F.filter("q", lambda y: F.lit(False)), lambda y: y.c), lambda acc, y: F.when((F.size(acc) < 2) & (_worst(y.c, acc) == 0), F.array_append(acc, y.c)).otherwise(acc))
    # written, so that the logos' pixels aren't on disk beside the posters'; a poster has two rows at most
    g = materialise(g.select("poster", two.alias("two")), "logo-clusters", tidy=True).select("poster", F.posexplode("two").alias("place", "c"))
    seen = px.with_oklab(poster_pixels.select("poster", "r", "g", "b")).join(g, "poster")
    near = colour.distance([F.col(c) for c in LAB], [F.col(f"c.{c}") for c in LAB]) < f["near"]
    there = seen.groupBy("poster", "place").agg((F.count_if(near) / F.count("*")).alias("present"), F.first("c").alias("c")).where(F.col("present") >= f["present"])
    return there.groupBy("poster").agg(F.array_sort(F.collect_list(F.struct("place", "c"))).alias("x")).select("poster", F.col("x.c").alias("logo"))


def solid(logo_pixels: DataFrame) -> DataFrame:
    """The opaque pixels of logos (poster, y, x, r, g, b, alpha), of logos with enough of them; evenly spaced ones of
    large logos, which bounds what is clustered."""
    x = logo_pixels.where(F.col("alpha") > LOGO["solid"])
    own = Window.partitionBy("poster")
    x = x.withColumns({"nth": F.row_number().over(own.orderBy("y", "x")) - 1, "all": F.count("*").over(own)}).where(F.col("all") >= LOGO["pixels"])
    return x.where(F.col("nth") % F.ceil(F.col("all") / LOGO["samples"]) == 0).select("poster", "y", "x", "r", "g", "b")


def _assigned(base: Column, logo: Column, ladder: Column, extra: Column, how: Rules) -> Column:
    """The base and five more colours, each apart from those before it as far as there are any.

    Identities take the logo's colours first, then the ladder's, those with a hue first; highlights the ladder's in
    order; the accent the livelier of the next two. Where the ladder has none by any limit, another artwork colour
    does, and last a tint of the base.
    """
    plain = lambda y, source: F.struct(*[y[c].alias(c) for c in ("hex", *LAB, "chroma", "hue")], F.lit(source).alias("source"))

    def bound(f: Callable[[Column], Column], **values: Column) -> Column:
        """``f`` of the values, each computed once; within a fold Spark would compute it wherever it is named."""
        return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), 0)

    def role(acc: Column, kind: Column) -> Column:
        so_far = acc.colours
        # the first of the logo's queue that isn't close to what there is; those before it are spent
        fits = F.filter(F.transform(acc.queue, lambda q, i: F.struct(i.alias("i"), q.alias("q"))), lambda z: (kind == "identity") & ~F.exists(so_far, lambda p: colour.distance([p[c] for c in LAB], [z.q[c] for c in LAB]) < how.gap))
        free = F.filter(F.transform(ladder, lambda y, i: F.struct(_worst(y, so_far, how).alias("level"), i.alias("i"), y.alias("y"))), lambda z: (z.level < 3) & ~F.array_contains(acc.used, z.i))
        return bound(lambda o: chosen(acc, kind, o), fits=F.get(fits, 0), free=free)

    def chosen(acc: Column, kind: Column, o: Column) -> Column:
        dull = lambda z: ((kind != "highlight") & (z.y.chroma < how.neutral)).cast("int")
        first = F.array_min(F.transform(o.free, lambda z: F.struct(z.level.alias("level"), dull(z).alias("dull"), z.i.alias("i"), z.y.alias("y"))))
        strict = F.slice(F.filter(o.free, lambda z: z.level == 0), 1, how.accents)
        lively = F.transform(strict, lambda z: F.struct(((1 - how.accent_vivid) * z.y.dominance + how.accent_vivid * (0.6 * _full(z.y.chroma, FULL["chroma"]) + 0.4 * z.y.distinct)).alias("s"), (-z.i).alias("n"), z.i.alias("i"), z.y.alias("y")))
        return bound(lambda t: taken(acc, kind, o, t), best=F.when(kind == "accent", F.array_max(lively)), first=first)

    def taken(acc: Column, kind: Column, o: Column, t: Column) -> Column:
        so_far = acc.colours
        spent = F.when(kind != "identity", 0).when(o.fits.isNotNull(), o.fits.i + 1).otherwise(F.size(acc.queue))
        rung = F.when(t.best.isNotNull(), F.struct(t.best.i.alias("i"), t.best.y.alias("y"))).when(t.first.isNotNull(), F.struct(t.first.i.alias("i"), t.first.y.alias("y")))
        spare = F.get(F.filter(extra, lambda y: _worst(y, so_far, how) < 3), 0)
        b, step = F.get(so_far, 0), 0.18 + 0.06 * F.size(so_far)
        light = colour.clip(b.ll + F.when(b.ll < 0.5, step).otherwise(-step), 0.02, 0.98)
        tint = lambda z: F.struct(colour.to_hex(*colour.oklab_to_rgb(z.light, b.la, b.lb)).alias("hex"), z.light.alias("ll"), b.la.alias("la"), b.lb.alias("lb"), b.chroma.alias("chroma"), b.hue.alias("hue"), F.lit("derived").alias("source"))
        other = bound(lambda z: F.when(z.spare.isNotNull(), plain(z.spare, "artwork")).otherwise(tint(z)), spare=spare, light=light)
        pick = F.when(o.fits.isNotNull(), o.fits.q).when(rung.isNotNull(), plain(rung.y, "artwork")).otherwise(other)
        used = F.when(o.fits.isNull() & rung.isNotNull(), F.array_append(acc.used, rung.i)).otherwise(acc.used)
        rest = F.slice(acc.queue, spent + 1, F.lit(9))
        return F.struct(F.array_append(so_far, pick).alias("colours"), used.alias("used"), rest.alias("queue"))

    start = F.struct(F.array(base).alias("colours"), F.array().cast("array<int>").alias("used"), logo.alias("queue"))
    return F.aggregate(F.array(*[F.lit(k) for k in ("identity", "identity", "highlight", "highlight", "accent")]), start, role).colours


def palette_v3(labelled: DataFrame, logos: DataFrame | None = None, detail: bool = False, how: Rules = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(poster, the six roles, sources, ladder, logo_colours) of clustered artworks, with the colours of their logos
    (poster, logo) where there are any, or of a column ``logo`` that summaries have. sources: base, logo, artwork or
    derived, by role. ``detail``: also ``colours``, the roles as structs, and ``logo``, what is known of the logo: its
    source (none, or unlocated where its own colours were looked for in the poster) and its colours. ``keep``: other
    columns of summaries."""
    own = f"array<struct<hex: string, {', '.join(f'{x}: double' for x in (*LAB, 'chroma', 'hue'))}, source: string>>"
    x = summaries.of(labelled)
    g = _described(x.where(F.exists("clusters", lambda y: y.label >= 0)))
    if logos is not None:
        g = g.join(logos, "poster", "left")
    logo = F.col("logo").cast(own) if "logo" in g.columns else F.lit(None).cast(own)
    g = _with_base(g).select("poster", *keep, F.transform("d", lambda z: z.c).alias("c"), "base", F.coalesce(logo, F.array().cast(own)).alias("logo"))
    g = g.withColumn("ladder", _ladder(F.col("c"), how))
    g = g.withColumn("roles", _assigned(F.col("base"), F.col("logo"), F.col("ladder"), F.col("c"), how))
    out = [F.col("roles")[i].hex.alias(r) for i, r in enumerate(ROLES)]
    about = F.struct(F.when(F.size("logo") > 0, "unlocated").otherwise("none").alias("source"), F.col("logo.hex").alias("colours"))
    more = [F.col("roles").alias("colours"), about.alias("logo")] if detail else []
    return g.select("poster", *keep, *out, F.col("roles.source").alias("sources"), F.col("ladder.hex").alias("ladder"), F.col("logo.hex").alias("logo_colours"), *more)
