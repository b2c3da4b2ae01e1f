"""Angles recorded in different units (problem 3).

A unit comes from, in this order: the row's own statement (its unit column or the
text that states its angles), a note of its stream, the statement of at least half
of the stream's rows, and else the size of the stream's values. For the last, the
mean log amplitude of every stream is taken as a draw from a mixture whose
components share one location and width (those of the amplitude in radians) and are
offset by the logs of the conversion factors. EM fits location, width and shares on
a histogram of the streams (streams of known unit keep their component); the
posterior assigns the unit, and one below ``sure`` is flagged as uncertain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions.missing import finite
from tracklane.operators.joins import join_checked
from tracklane.session import cut

# Units, how many radians one of each is, and how they are spelled.
RADIANS = {
    "rad": 1.0,
    "deg": math.pi / 180,
    "mrad": 0.001,
    "cdeg": math.pi / 18000,
    "grad": math.pi / 200,
    "turn": 2 * math.pi,
}
SPELLINGS = {
    "rad": ["rad", "rads", "radian", "radians"],
    "deg": ["deg", "degs", "degree", "degrees", "°", "º"],
    "mrad": ["mrad", "mrads", "millirad", "millirads", "milliradian", "milliradians"],
    "cdeg": ["cdeg", "centideg", "centidegree", "centidegrees", "deg*100", "degrees*100"],
    "grad": ["grad", "grads", "gradian", "gradians", "gon", "gons"],
    "turn": ["turn", "turns", "rev", "revs", "revolution", "revolutions"],
}
UNITS = list(RADIANS)
NAMES = ("roll", "pitch", "yaw")

_words = sorted((w for ws in SPELLINGS.values() for w in ws), key=len, reverse=True)
_UNIT_RE = r"(?<![\p{L}])(" + "|".join(w.replace("*", r"\s*\*\s*") for w in _words) + r")(?![\p{L}]|\s*\*)"
_SCOPE_RE = r"\b(all|any|every|each|below|following|follows?|above|throughout|header|log|file|stream|recording|default|units?)\b"  # of more than one row
_NUM = r"[-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?"
_DMS = r"([-+]?)(\d+)\s*°\s*(\d+)\s*'\s*(\d+(?:\.\d+)?)\s*\""


@dataclass(frozen=True)
class UnitConfig:
    bin_width: float = 0.02
    rounds: int = 60
    least_sigma: float = 0.1
    spread: float = 1.1  # of one row's log amplitude about its stream's mean
    sure: float = 0.95
    circle_slack: float = 1.02


def unit_of(word: Column) -> Column:
    """The unit a spelling names, else null."""
    units = F.create_map(*(F.lit(x) for unit, words in SPELLINGS.items() for w in words for x in (w, unit)))
    return F.try_element_at(units, F.regexp_replace(F.lower(word), r"\s", ""))


def text_angles(text: Column) -> dict[str, Column]:
    """roll, pitch, yaw stated in a text (else null), and the unit it names.

    Understood are named values in any order, three values in the order roll, pitch,
    yaw, decimal commas, and degrees with minutes and seconds.
    """
    t = F.lower(text)
    unit = unit_of(F.nullif(F.regexp_extract(t, _UNIT_RE, 1), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(t, _UNIT_RE, " "), r"(?<=\d),(?=\d)", ".")
    part = lambda g: F.regexp_extract_all(t, F.lit(_DMS), F.lit(g))
    numbers = F.regexp_extract_all(bare, F.lit(rf"(?<![\p{{L}}\d.])({_NUM})"), F.lit(1))
    out = {}
    for i, (name, short) in enumerate(zip(NAMES, "rpy", strict=True)):
        named = F.regexp_extract(bare, rf"(?:^|[^\p{{L}}])(?:{name}|{short})\s*[=:]?\s*({_NUM})", 1).try_cast("double")
        at = lambda g, i=i: F.get(part(g), F.lit(i))
        dms = at(2).try_cast("double") + at(3).try_cast("double") / 60 + at(4).try_cast("double") / 3600
        dms = F.when(at(1) == "-", -dms).otherwise(dms)
        placed = F.when(F.size(numbers) == 3, F.get(numbers, F.lit(i)).try_cast("double"))
        out[name] = F.when(t.rlike(_DMS), dms).otherwise(F.coalesce(named, placed))
    return out | {"unit": unit}


def fit_offsets(known: dict[tuple[float, str], int], unknown: dict[float, int], cfg: UnitConfig = UnitConfig()) -> dict:
    """EM over histograms. known: (log amplitude as recorded, unit) to count; unknown: log amplitude to count."""
    offset = np.array([-math.log(RADIANS[u]) for u in UNITS])
    kx = np.array([x - offset[UNITS.index(u)] for x, u in known])
    kn = np.array(list(known.values()), float)
    share = np.array([1.0 + sum(n for (_, v), n in known.items() if v == u) for u in UNITS])
    ux, un = np.array(list(unknown), float), np.array(list(unknown.values()), float)
    if len(kx):
        mu = float((kx * kn).sum() / kn.sum())
        sigma = math.sqrt(float((kn * (kx - mu) ** 2).sum() / kn.sum()))
    else:
        mu, sigma = math.log(0.05), 0.5  # a few degrees, as attitudes of vehicles in motion are
    sigma, base, p = max(sigma, cfg.least_sigma), share.copy(), share / share.sum()
    for _ in range(cfg.rounds if len(ux) else 0):
        z = (ux[:, None] - offset - mu) / sigma
        logp = np.log(p) - 0.5 * z * z
        r = np.exp(logp - logp.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        w = r * un[:, None]
        p = base + w.sum(0)
        p /= p.sum()
        x = np.concatenate([kx, (ux[:, None] - offset).ravel()])
        n = np.concatenate([kn, w.ravel()])
        mu = float((x * n).sum() / n.sum())
        sigma = max(math.sqrt(float((n * (x - mu) ** 2).sum() / n.sum())), cfg.least_sigma)
    return {"mu": mu, "sigma": sigma, "share": dict(zip(UNITS, p.tolist(), strict=True))}


def _most(counts: dict[str, Column]) -> Column:
    """The unit of the largest count; of equals the first in UNITS. Null where all are 0."""
    top = F.greatest(*counts.values())
    out = F.lit(None).cast("string")
    for u in reversed(UNITS):
        out = F.when((counts[u] == top) & (top > 0), u).otherwise(out)
    return out


def to_radians(
    df: DataFrame, row_id: str, stream: list[str], unit_col: str = "angle_unit", text_col: str = "raw_text", cfg: UnitConfig = UnitConfig()
) -> DataFrame:
    """(row_id, stream..., unit, unit_from, posterior, uncertain, roll_rad, pitch_rad, yaw_rad) of each row that holds an angle.

    Rows without an angle, in numbers or in text, are left out. Null, NaN and
    infinite angles count as not held; a held angle beside them is converted. yaw is
    wrapped to -pi..pi. A null stream key is a stream of its own; repeated rows are
    judged each. An empty table gives an empty result. Other columns are ignored.
    """
    in_numbers = finite(F.col("roll")) | finite(F.col("pitch")) | finite(F.col("yaw"))
    keys = [f"_s{i}" for i in range(len(stream))]
    d = df.select(
        F.col(row_id).alias("_id"),
        *(F.col(s).alias(k) for s, k in zip(stream, keys, strict=True)),
        *(F.when(finite(F.col(n).cast("double")), F.col(n).cast("double")).alias(n) for n in NAMES),
        in_numbers.alias("_held"),
        unit_of(F.col(unit_col)).alias("stated"),
        F.when(F.col(text_col).rlike(r"\S"), F.col(text_col)).alias("_text"),
    )
    d = cut(d.withColumns({f"_{n}": c for n, c in text_angles(F.col("_text")).items()}))  # texts are parsed once
    none = F.coalesce(*(f"_{n}" for n in NAMES)).isNull()
    is_note = none & F.col("_unit").isNotNull() & (~F.col("_held") | F.lower("_text").rlike(_SCOPE_RE))
    rows = d.select(
        "_id",
        *keys,
        *(F.when(F.col("_held"), F.col(n)).otherwise(F.col(f"_{n}")).alias(n) for n in NAMES),
        F.coalesce("stated", F.when(~is_note, F.col("_unit"))).alias("own"),
        F.when(is_note, F.col("_unit")).alias("note"),
    )
    holds = F.coalesce("roll", "pitch", "yaw").isNotNull()
    tilt = F.greatest(F.abs("roll"), F.abs("pitch"))
    bare = holds & F.col("own").isNull()
    size = F.when(bare & (tilt > 0), F.log(tilt))
    streams = cut(
        rows.groupBy(*keys).agg(
            *(F.count_if(F.col("note") == u).alias(f"note_{u}") for u in UNITS),
            *(F.count_if(holds & (F.col("own") == u)).alias(f"own_{u}") for u in UNITS),
            F.count_if(holds).alias("n"),
            F.count(size).alias("n_size"),
            F.avg(size).alias("size"),
            F.max(F.when(bare, F.abs("yaw"))).alias("yaw_max"),
            *(F.avg(F.when(holds & (F.col("own") == u) & (tilt > 0), F.log(tilt))).alias(f"size_{u}") for u in UNITS),
        )
    )
    noted = _most({u: F.col(f"note_{u}") for u in UNITS})
    stated = _most({u: F.col(f"own_{u}") for u in UNITS})
    half = sum((F.col(f"own_{u}") for u in UNITS), F.lit(0)) * 2 >= F.col("n")
    streams = streams.withColumn("noted", noted).withColumn("stated", F.when(half, stated))
    known = F.coalesce("noted", "stated")
    binned = lambda x: F.round(F.round(x / cfg.bin_width) * cfg.bin_width, 6)
    # bounded: one row per unit and bin of a log amplitude
    hist = streams.filter(F.col("size").isNotNull()).groupBy(binned(F.col("size")).alias("x"), known.alias("u")).count().collect()
    extra = streams.select(F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.col(f"size_{u}").alias("x")) for u in UNITS))).alias("e"))
    extra = extra.filter("e.x is not null").groupBy(binned(F.col("e.x")).alias("x"), F.col("e.u").alias("u")).count().collect()
    hist, extra = sorted(hist, key=str), sorted(extra, key=str)
    labelled: dict[tuple[float, str], int] = {}
    for r in [*hist, *extra]:
        if r["u"]:
            labelled[r["x"], r["u"]] = labelled.get((r["x"], r["u"]), 0) + r["count"]
    fit = fit_offsets(labelled, {r["x"]: r["count"] for r in hist if not r["u"]}, cfg)

    width2 = F.lit(fit["sigma"] ** 2) + F.lit(cfg.spread**2) / F.greatest(F.col("n_size"), F.lit(1))
    weight = {}
    for u in UNITS:
        z = F.coalesce(F.col("size"), F.lit(fit["mu"] - math.log(RADIANS[u]))) - F.lit(fit["mu"] - math.log(RADIANS[u]))
        fits = F.coalesce(F.col("yaw_max"), F.lit(0.0)) <= 2 * math.pi / RADIANS[u] * cfg.circle_slack
        weight[u] = F.when(fits, F.lit(math.log(fit["share"][u])) - z * z / (2 * width2)).otherwise(F.lit(-1e9))
    top = F.greatest(*weight.values())
    guess = F.lit(None).cast("string")
    for u in reversed(UNITS):
        guess = F.when(weight[u] == top, u).otherwise(guess)
    streams = streams.withColumn("guess", guess).withColumn("p", 1 / sum((F.exp(F.greatest(w - top, F.lit(-700.0))) for w in weight.values()), F.lit(0.0)))
    small = streams.select(*keys, "noted", "stated", "guess", "p")
    out = join_checked(rows.filter(holds), small, keys)
    unit = F.coalesce("own", "noted", "stated", "guess")
    source = (
        F.when(F.col("own").isNotNull(), "row").when(F.col("noted").isNotNull(), "note").when(F.col("stated").isNotNull(), "stream").otherwise("size")
    )
    by = F.lit(None).cast("double")
    for u, f in RADIANS.items():
        by = F.when(F.col("unit") == u, F.lit(f)).otherwise(by)
    out = out.withColumn("unit", unit).withColumn("unit_from", source)
    out = out.withColumn("posterior", F.when(F.col("unit_from") == "size", F.col("p")).otherwise(F.lit(1.0)))
    wrapped = F.col("yaw") * by - F.lit(2 * math.pi) * F.floor((F.col("yaw") * by + math.pi) / (2 * math.pi))
    return out.select(
        F.col("_id").alias(row_id),
        *(F.col(k).alias(s) for s, k in zip(stream, keys, strict=True)),
        "unit",
        "unit_from",
        "posterior",
        (F.col("posterior") < cfg.sure).alias("uncertain"),
        (F.col("roll") * by).alias("roll_rad"),
        (F.col("pitch") * by).alias("pitch_rad"),
        wrapped.alias("yaw_rad"),
    )
